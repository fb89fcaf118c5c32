"""Round semantics in batch form: barrier, deadline, churn, exclusion, fallback, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import RoundError
from ..functions import rng


def received(messages: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return messages.join(expected.select(*keys).distinct(), keys, "left_semi")


def missing(messages: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(messages.select(*keys).distinct(), keys, "left_anti")


def deadline_status(arrival: Column, start: Column, deadline: str) -> Column:
    """arrived if the message came by the deadline, else timed_out."""
    return F.when(arrival.isNotNull() & (arrival <= start + F.expr(f"interval {deadline}")), "arrived").otherwise("timed_out")


def churn_dropped(seed: int, round_no: Column, peer: Column, p: float, receiver: Column | None = None) -> Column:
    return rng.churn_uniform(F.lit(rng.signed(seed)), round_no, peer, receiver) < F.lit(p)


def apply_churn(status: DataFrame, seed: int, p: float) -> DataFrame:
    """Arrived messages whose sender is drawn become churn_dropped."""
    drop = churn_dropped(seed, F.col("round"), F.col("sender"), p)
    return status.withColumn("status", F.when((F.col("status") == "arrived") & drop, "churn_dropped").otherwise(F.col("status")))


def prune(messages: DataFrame, round_no) -> DataFrame:
    """Drop the messages of rounds before ``round_no``; the current and early ones stay."""
    return messages.where(F.col("round") >= F.lit(round_no))


def sticky_fallback(rounds: DataFrame, keys: list[str], order: str, lost: str) -> DataFrame:
    """Add ``fallback``: a peer was lost in this round or before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("fallback", F.max(F.col(lost)).over(w))


def liveness_transitions(probes: DataFrame, keys: list[str], order: list[str], up: str) -> DataFrame:
    """Probes whose state differs from the one before; every address starts down."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return probes.withColumn("was_up", F.lag(up, 1, False).over(w)).where(F.col(up) != F.col("was_up")).drop("was_up")


def apply_delta(delta: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """delta + base by (keys, idx). A delta without a base, or of another size, is an error."""
    joined = delta.withColumnRenamed("value", "d").join(base.withColumnRenamed("value", "b"), [*keys, "idx"], "full_outer")
    whole = F.when(
        F.col("d").isNull() | F.col("b").isNull(), F.raise_error(F.lit("delta and base have different elements")).cast("double")
    ).otherwise(F.col("d") + F.col("b"))
    return joined.select(*keys, "idx", whole.alias("value"))


def sends_delta(compression: str, fallback: bool, has_base: bool, same_tensors: bool = True) -> bool:
    return compression == "topk" and not fallback and has_base and same_tensors


def require_mesh(peers: DataFrame, compression: str, allow: bool = False) -> None:
    """Deltas refer to the receiver's own aggregate, which all nodes share only in a full mesh."""
    if compression != "topk" or allow:
        return
    nodes = peers.select("node_id").union(peers.select(F.col("peer_id").alias("node_id"))).distinct().count()
    if peers.where("node_id <> peer_id").distinct().count() != nodes * (nodes - 1):
        raise RoundError("top-k deltas need a full mesh")


def full_batches(n: Column, batch: int) -> Column:
    return F.floor(n / batch) * batch


def batch_numbers(samples: DataFrame, keys: list[str], order: list[Column], batch: int) -> DataFrame:
    """Add ``batch`` (0-based) in the given order; the last partial batch of each key is dropped."""
    w = Window.partitionBy(*keys)
    pos = F.row_number().over(w.orderBy(*order)) - 1
    return (
        samples.withColumn("pos", pos)
        .withColumn("n", F.count(F.lit(1)).over(w))
        .where(F.col("pos") < full_batches(F.col("n"), batch))
        .withColumn("batch", F.floor(F.col("pos") / batch).cast("int"))
        .drop("n")
    )
