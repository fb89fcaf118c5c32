"""The round loop: all nodes of a federation as rows, one DataFrame program a round.

train (grouped map) -> encode -> push to the peers -> deadline and churn -> decode
-> weighted average -> evaluate -> log. Each round's parameters are checkpointed in
the cluster's shared folder, so lineage stays short and a lost executor costs one
round at most.

The network is a table, ``arrivals`` (round, sender, receiver, arrival_s): when a
push arrives, or null if it never does. Pairs that it does not name arrive at once.
``ready`` (node_id, ready_s) says when a node can first be reached.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import RoundError
from ..functions import codec, scalars
from ..functions.rng import SplitMix64
from ..operators import aggregate, rounds, topology
from ..operators.order import durable
from ..schemas import PEER_EVENTS, ROUND_LOG, SCHEMA_VERSION
from ..sources import npy, telemetry
from .nn import Model, evaluate_nodes, guard, pack, train_nodes


@dataclass
class RunOptions:
    """Options of a run; values out of range are refused (``clamped`` clamps two of them instead)."""

    rounds: int = 5
    learning_rate: float = 0.01
    seed: int = 42
    compression: str = "none"
    topk_ratio: float = 0.1
    error_feedback: bool = True
    eval_every: int = 1
    churn: float = 0.0
    churn_seed: int = 0
    allow_sparse_delta: bool = False
    #: Seconds that a receiver waits for its peers in a round; None waits for ever, so that a lost push is an error.
    peer_deadline_s: float | None = None
    #: Seconds in which a failed push is tried again (None: the deadline).
    push_retry_s: float | None = None
    #: Seconds in which a node must be reachable; others are left out of the whole run.
    startup_deadline_s: float | None = None
    condition: str = "iid"
    #: Folder for round log, peer events, run configuration and final weights; nothing is written without one.
    out: str | None = None
    #: How updates are averaged: (updates, local, keys) -> DataFrame of keys and value.
    average: Callable = aggregate.average_or_local
    #: Called with each round's entry of the history.
    on_round: Callable | None = None
    history: list = field(default_factory=list)

    def __post_init__(self):
        known = [*codec.ROUNDTRIPS, "topk"]
        if self.compression not in known:
            raise RoundError(f"compression {self.compression} is not one of {', '.join(known)}")
        low = [x for x in (self.peer_deadline_s, self.push_retry_s, self.startup_deadline_s) if x is not None]
        if self.eval_every < 1 or not 0 < self.topk_ratio <= 1 or self.rounds < 1 or not 0 <= self.churn < 1 or any(x < 0 for x in low):
            raise RoundError("an option is out of range")

    @classmethod
    def clamped(cls, **options) -> RunOptions:
        """The evaluation cadence at least 1 and the top-k ratio in 0.0001 to 1."""
        options["eval_every"] = max(1, options.get("eval_every", 1))
        options["topk_ratio"] = min(1.0, max(0.0001, options.get("topk_ratio", 0.1)))
        return cls(**options)


def transmit(long: DataFrame, compression: str, keys: list[str]) -> DataFrame:
    """``value`` as a receiver will read it, for long tensors (keys, idx, value)."""
    if compression == "none":
        return long
    w = Window.partitionBy(*keys)
    low, high = (F.min("value").over(w), F.max("value").over(w)) if compression != "fp16" else (F.lit(None), F.lit(None))
    ranged = long.withColumns({"__pl_low": low, "__pl_high": high})
    return ranged.withColumn("value", codec.ROUNDTRIPS[compression](F.col("value"), F.col("__pl_low"), F.col("__pl_high"))).drop("__pl_low", "__pl_high")


def outcome(edges: DataFrame, round_no: int, options: RunOptions, arrivals: DataFrame | None) -> DataFrame:
    """round, sender, receiver, arrival_s, status of every push of a round: arrived, timed_out or churn_dropped."""
    status = edges.withColumn("round", F.lit(round_no))
    if arrivals is None:
        status = status.withColumn("arrival_s", F.lit(0.0))
    else:
        named = arrivals.where(F.col("round") == round_no).select("sender", "receiver", "arrival_s", F.lit(True).alias("named"))
        status = status.join(named, ["sender", "receiver"], "left").withColumn(
            "arrival_s", F.when(F.col("named"), F.col("arrival_s").cast("double")).otherwise(0.0)
        ).drop("named")
    if options.peer_deadline_s is None:
        status = status.withColumn("status", F.when(F.col("arrival_s").isNotNull(), "arrived").otherwise("lost"))
    else:
        status = status.withColumn("status", F.when(F.col("arrival_s") <= options.peer_deadline_s, "arrived").otherwise("timed_out"))
    return rounds.apply_churn(status, options.churn_seed, options.churn) if options.churn else status


def merge(wire: DataFrame, local: DataFrame, status: DataFrame, counts: dict, base: DataFrame | None, options: RunOptions) -> DataFrame:
    """node_id, tensor_id, idx, value: every node's average of its own update and of those that reached it.

    wire: node_id, tensor_id, idx, value, delta, sample_count. A receiver adds a delta to its own base. Receivers
    that heard every other node share one sum over all of them, from which each takes its own message and puts in
    its own update, so that a full mesh is summed once; the others sum what they got.
    """
    keys = ["node_id", "tensor_id", "idx"]
    n = F.col("sample_count")
    heard = status.where("status = 'arrived' and sender <> receiver").groupBy(F.col("receiver").alias("node_id")).agg(F.count(F.lit(1)).alias("heard"))
    sent = {r["node_id"] for r in wire.select("node_id").distinct().collect()}
    selfish = {r["receiver"] for r in status.where("status = 'arrived' and sender = receiver").select("receiver").collect()}
    full = {r["node_id"] for r in heard.collect() if r["heard"] == len(sent) - 1 and r["node_id"] in sent} - selfish
    if len(sent) == 1:
        full = sent - selfish
    if options.average is not aggregate.average_or_local or sum(counts.values()) == 0:
        full = set()
    own = local.join(wire.select(*keys, F.col("value").alias("sent"), "delta", "sample_count"), keys)
    own = own.join(base.withColumnRenamed("value", "base"), keys, "left") if base is not None else own.withColumn("base", F.lit(None).cast("float"))
    out = []
    if full:
        total = wire.groupBy("tensor_id", "idx").agg(
            F.sum(n * F.col("value").cast("double")).alias("s"), F.sum(F.when(F.col("delta"), n).otherwise(0)).alias("nd"), F.sum(n).alias("n")
        )
        here = own.where(F.col("node_id").isin(sorted(full))).join(total, ["tensor_id", "idx"])
        deltas = F.col("nd") - F.when(F.col("delta"), n).otherwise(0)
        based = F.when(deltas > 0, F.coalesce(F.col("base").cast("double"), F.raise_error(F.lit("a delta without a base")).cast("double")) * deltas).otherwise(0.0)
        value = (F.col("s") - n * F.col("sent").cast("double") + based + n * F.col("value").cast("double")) / F.col("n")
        out.append(here.select(*keys, value.alias("value")))
    if set(sent) - full:
        arrived = status.where("status = 'arrived'").where(~F.col("receiver").isin(sorted(full)) if full else F.lit(True)).select("sender", "receiver")
        got = wire.withColumnRenamed("node_id", "sender").join(arrived, "sender").withColumnRenamed("receiver", "node_id")
        if base is not None:
            got = got.join(base.withColumnRenamed("value", "base"), keys, "left")
            whole = F.coalesce(F.col("base"), F.raise_error(F.lit("a delta without a base")).cast("float")) + F.col("value")
            got = got.withColumn("value", F.when(F.col("delta"), whole).otherwise(F.col("value")))
        rest = own.where(~F.col("node_id").isin(sorted(full))) if full else own
        updates = got.select(*keys, F.col("value").cast("double").alias("value"), "sample_count").unionByName(
            rest.select(*keys, F.col("value").cast("double").alias("value"), "sample_count")
        )
        out.append(options.average(updates, rest.select(*keys, "value"), keys).select(*keys, "value"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def run(
    samples: DataFrame,
    peers: DataFrame,
    model: Model,
    options: RunOptions,
    test: DataFrame | None = None,
    arrivals: DataFrame | None = None,
    ready: DataFrame | None = None,
) -> DataFrame:
    """Final params (node_id, tensor_id, values); each round's entry is appended to ``options.history``.

    samples: node_id, sample_idx, image, label. peers: node_id, peer_id. test: sample_idx, image, label, given
    to every node. Under top-k a node averages what its peers can rebuild of its own update, and sends full weights
    for the rest of the run once it has lost a peer. What the driver holds grows with nodes and links, never with
    samples or parameters.
    """
    import pandas as pd

    spark = samples.sparkSession
    late = []
    if options.startup_deadline_s is not None and ready is not None:
        reached = ready.where(F.col("ready_s") <= options.startup_deadline_s)
        absent = rounds.missing(reached.select("node_id"), samples.select("node_id").distinct(), ["node_id"])
        late = sorted(r["node_id"] for r in absent.collect())
    events = [_event(0, r["node_id"], r["peer_id"], 0, 0.0, False, "excluded_at_startup")
              for r in peers.where(F.col("peer_id").isin(late) & ~F.col("node_id").isin(late)).collect()] if late else []
    if late:
        out = spark.createDataFrame([(x,) for x in late], "id long")
        peers, samples = topology.exclude(peers, out), samples.where(~F.col("node_id").isin(late))
    peers = peers.select(F.col("node_id").cast("long").alias("node_id"), F.col("peer_id").cast("long").alias("peer_id"))
    rounds.require_mesh(peers, options.compression, options.allow_sparse_delta)
    samples = samples.withColumn("node_id", F.col("node_id").cast("long")).persist()
    counts = guard(samples, model)
    nodes = sorted(counts)
    first = model.start(options.seed)
    params = spark.createDataFrame(pd.concat([pack(n, first) for n in nodes]), "node_id long, tensor_id int, values array<float>")
    seeds = SplitMix64(options.seed)
    seeds.next()
    base, left, lost = None, None, set()
    known = set(nodes)
    edges = peers.where(F.col("peer_id").isin(nodes) & F.col("node_id").isin(nodes)).select(F.col("peer_id").alias("sender"), F.col("node_id").alias("receiver"))
    links = [(r["sender"], r["receiver"]) for r in edges.collect()]
    edges = spark.createDataFrame(links, "sender long, receiver long") if links else edges.limit(0)
    sample_count = F.element_at(F.create_map(*[F.lit(x) for n in nodes for x in (n, counts[n])]), F.col("node_id"))
    keys = ["node_id", "tensor_id"]
    log, elapsed = [], time.perf_counter()
    for r in range(1, options.rounds + 1):
        began = time.perf_counter()
        trained = durable(train_nodes(samples, params, model, seeds.next(), options.learning_rate))
        metrics = {row["node_id"]: row.asDict() for row in trained.where("tensor_id = 0").drop("values", "tensor_id").collect()}
        own = trained.select("node_id", "tensor_id", F.posexplode("values").alias("idx", "value"))
        senders = {n for n in known if rounds.sends_delta(options.compression, n in lost, base is not None)}
        wire = transmit(own.where(~F.col("node_id").isin(sorted(senders))) if senders else own,
                        "none" if options.compression == "topk" else options.compression, keys).withColumn("delta", F.lit(False))
        local = own
        if senders:
            ours = own.where(F.col("node_id").isin(sorted(senders))).join(base.withColumnRenamed("value", "b"), [*keys, "idx"], "left")
            change = F.col("value") - F.coalesce(F.col("b"), F.raise_error(F.lit("a node that sends a delta has no base")).cast("float"))
            ours = ours.withColumn("value", change)
            if left is not None and options.error_feedback:
                owed = F.coalesce("residual", F.lit(0.0).cast("float"))
                ours = ours.join(left, [*keys, "idx"], "left").withColumn("value", F.col("value") + owed).drop("residual")
            n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
            marked = durable(codec.residual(codec.top_k(ours.withColumn("k", codec.keep_count(n, options.topk_ratio)), keys, F.col("k"))))
            left = marked.select(*keys, "idx", "residual")
            sent = marked.withColumn("value", F.when(F.col("kept"), F.col("value")).otherwise(F.lit(0.0)).cast("float"))
            wire = wire.unionByName(sent.select(*keys, "idx", "value", F.lit(True).alias("delta")))
            seen = sent.select(*keys, "idx", (F.col("b") + F.col("value")).cast("float").alias("value"))
            local = own.where(~F.col("node_id").isin(sorted(senders))).unionByName(seen)
        wire = durable(wire.withColumn("sample_count", sample_count))
        status = durable(outcome(edges, r, options, arrivals))
        told = status.collect()
        if gone := [x for x in told if x["status"] == "lost"]:
            raise RoundError(f"round {r}: the push of node {gone[0]['sender']} to node {gone[0]['receiver']} failed, and no deadline is set")
        mark = time.perf_counter()
        base = durable(merge(wire, local, status, counts, base, options).withColumn("value", F.col("value").cast("float")))
        aggregate_s = time.perf_counter() - mark
        missed = {x["receiver"] for x in told if x["status"] != "arrived"}
        lost |= missed
        params = base.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda e: e["value"]).alias("values")
        )
        bytes_ = {x["node_id"]: (x["wire_bytes"], x["payload_bytes"]) for x in _bytes(wire, options).collect()}
        entry = {"round": r, "delta": bool(senders), "senders_of_deltas": sorted(senders), "dropped": sum(x["status"] == "churn_dropped" for x in told),
                 "timed_out": sum(x["status"] == "timed_out" for x in told), "nodes": metrics}
        if options.eval_every <= 1 or r % options.eval_every == 0 or r == options.rounds:
            entry["local"] = {x["node_id"]: (x["loss"], x["accuracy"], x["eval_s"]) for x in evaluate_nodes(samples, params, model).collect()}
            if test is not None:
                everyone = test.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in nodes], "node_id long")))
                entry["test"] = {x["node_id"]: (x["loss"], x["accuracy"], x["eval_s"]) for x in evaluate_nodes(everyone, params, model).collect()}
        events += [
            _event(r, x["sender"], x["receiver"], bytes_[x["sender"]][0], x["arrival_s"] or 0.0, _pushed(x["arrival_s"], options), "push") for x in told
        ] + [
            _event(r, x["receiver"], x["sender"], 0, options.peer_deadline_s or 0.0, False, "timeout" if x["status"] == "timed_out" else "churn_dropped")
            for x in told if x["status"] != "arrived"
        ]
        now = time.perf_counter()
        log += [_row(n, r, entry, told, bytes_[n], options, now - elapsed, now - began, aggregate_s) for n in nodes]
        options.history.append(entry)
        if options.on_round:
            options.on_round(entry)
    samples.unpersist()
    if options.out:
        _write(spark, params, log, events, options)
    return params


def _pushed(arrival_s, options: RunOptions) -> bool:
    """Whether a push got through at all, within the time in which it is tried again."""
    budget = options.push_retry_s if options.push_retry_s is not None else options.peer_deadline_s
    return arrival_s is not None and (budget is None or arrival_s <= budget)


def _bytes(wire: DataFrame, options: RunOptions) -> DataFrame:
    code = codec.WIRE.get(options.compression, codec.DENSE)
    plain = codec.DENSE if options.compression == "topk" else code
    entries = F.count_if((F.col("value") != 0) | F.isnan("value"))
    tensors = wire.groupBy("node_id", "tensor_id", "delta").agg(F.count(F.lit(1)).alias("n"), entries.alias("nnz"))
    return codec.message_bytes(tensors.withColumn("encoding", F.when(F.col("delta"), F.lit(code)).otherwise(F.lit(plain))), ["node_id"])


def _event(round_no, source, target, size, duration, success, kind) -> tuple:
    return (round_no, int(source), int(target), int(size), float(duration), success, time.time(), kind, str(target))


def _row(n, r, entry, told, size, options, elapsed, total, aggregate_s) -> dict:
    """One line of the round log."""
    m, mine, sent = entry["nodes"][n], [x for x in told if x["receiver"] == n], [x for x in told if x["sender"] == n]
    test, local = entry.get("test", {}).get(n, (None, None, 0.0)), entry.get("local", {}).get(n, (None, None, 0.0))
    count = lambda s: sum(x["status"] == s for x in mine)
    wait = max((options.peer_deadline_s if x["status"] == "timed_out" else x["arrival_s"] for x in mine), default=0.0)
    push = max((x["arrival_s"] for x in sent if x["arrival_s"] is not None), default=0.0)
    evaluated = (test[2] or 0.0) + (local[2] or 0.0)
    whole = count("timed_out") + count("churn_dropped") == 0
    return {
        "round": r, "node_id": n, "condition": options.condition, "train_loss": m["train_loss"], "train_acc": m["train_acc"],
        "test_loss": test[0], "test_acc": test[1], "local_loss": local[0], "local_acc": local[1], "eval_test_s": test[2] or 0.0,
        "eval_local_s": local[2] or 0.0, "eval_total_s": evaluated, "fwd_s": m["fwd_s"], "bwd_s": m["bwd_s"], "opt_s": m["opt_s"], "shuf_s": m["shuf_s"],
        "train_acc_s": m["train_acc_s"], "gossip_push_s": push, "gossip_agg_s": max(push, wait) + aggregate_s, "gossip_wait_s": wait,
        "gossip_aggregate_s": aggregate_s, "bytes_sent": size[0] * len(sent), "wire_bytes_sent": size[0] * len(sent),
        "payload_bytes_sent": size[1] * len(sent), "peak_rss_mb": m["peak_rss_mb"], "effective_cores": m["effective_cores"],
        "throttled": "unavailable", "n_samples": m["n_samples"], "elapsed_s": elapsed, "round_total_s": total - evaluated,
        "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "peers_reached": count("arrived"), "peers_expected": len(mine),
        "peers_timed_out": count("timed_out"), "peers_churn_dropped": count("churn_dropped"),
        "status": "completed" if whole else "partial_peers_unreachable", "schema_version": SCHEMA_VERSION,
    } | dict.fromkeys(telemetry.NEVER_MEASURED, -1)


def round_log(spark, log: list[dict]) -> DataFrame:
    """The rows of the round log with its fixed columns and types."""
    columns = [x.split() for x in ROUND_LOG.split(", ")]
    texts = spark.createDataFrame([[None if row[c] is None else str(row[c]) for c, _ in columns] for row in log], ", ".join(f"{c} string" for c, _ in columns))
    return texts.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


def _write(spark, params: DataFrame, log: list[dict], events: list[tuple], options: RunOptions) -> None:
    at = lambda name: os.path.join(options.out, name)
    telemetry.write_round_log(round_log(spark, log), at("rounds"))
    telemetry.write_peer_events(spark.createDataFrame(events, PEER_EVENTS), at("peer_events"))
    plain = {f.name: getattr(options, f.name) for f in fields(options) if f.name not in ("average", "on_round", "history")}
    named = spark.createDataFrame([(options.condition,)], "raw string")
    parsed = named.select(*[c.alias(n) for n, c in scalars.condition(F.col("raw")).items()]).first().asDict()
    telemetry.write_config(plain | parsed | {"system": telemetry.system_state()}, at("run_config.json"))
    npy.save_weights(params, at("weights"))
