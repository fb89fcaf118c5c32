import datetime
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerloom.engine import Engine
from peerloom.errors import CodecError, NpyError, RoundError, TopologyError, TrainerError
from peerloom.functions import codec
from peerloom.functions.rng import SplitMix64
from peerloom.operators import topology
from peerloom.plans import federation, nn
from peerloom.schemas import ROUND_LOG
from peerloom.sources import frames, npy, telemetry
from peerloom.streaming import collector


def test_network_sizes_and_first_weights():
    p = nn.init(42)
    assert [x.size for x in p] == [432, 16, 4608, 32, 18432, 64, 2560, 10]
    assert p[0].reshape(-1)[:4] == pytest.approx([0.112872, 0.177637, -0.242741, 0.361118], abs=1e-4)


def test_gradients_by_finite_differences():
    rand = np.random.default_rng(0)
    p = [x.astype(np.float64) for x in nn.init(1, (2, 3, 4), 5, 12)]
    x, y = rand.random((4, 2, 12, 12)), np.array([0, 1, 2, 3])
    probs, state = nn.forward(p, x)
    grads = nn.backward(p, probs, y, state)
    for k, g in enumerate(grads):
        flat = p[k].reshape(-1)
        for i in rand.integers(0, flat.size, 4):
            old, h = flat[i], 1e-6
            flat[i] = old + h
            up = -np.log(nn.forward(p, x)[0][np.arange(4), y]).mean()
            flat[i] = old - h
            down = -np.log(nn.forward(p, x)[0][np.arange(4), y]).mean()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_pool_shares_ties():
    top, share = nn.pool_forward(np.array([[[[1.0, 1.0, 9.0], [0.0, 1.0, 9.0], [5.0, 5.0, 9.0]]]]))
    assert top.tolist() == [[[[1.0]]]] and share[0, 0, 0, :, 0].tolist() == [[1 / 3, 1 / 3], [0.0, 1 / 3]]


def test_loss_starts_near_log_10_and_falls():
    rand = np.random.default_rng(3)
    x, y = rand.random((64, 3, 32, 32)).astype(np.float32), rand.integers(0, 10, 64)
    p, first = nn.init(42), None
    for r in range(4):
        p, m = nn.epoch(p, x, y, r, accuracy=False)
        first = first or m["train_loss"]
    assert 1.8 < first < 4 and m["train_loss"] < first
    with pytest.raises(TrainerError):
        nn.epoch(p, x[:10], y[:10], 0)


def blobs(spark, nodes=4, n=64):
    rand = np.random.default_rng(5)
    centre = rand.normal(0, 1, (4, 8))
    rows = []
    for node in range(nodes):
        y = rand.integers(0, 4, n)
        rows += [(node, i, (centre[c] + rand.normal(0, 0.3, 8)).tolist(), int(c)) for i, c in enumerate(y)]
    return spark.createDataFrame(rows, "node_id long, sample_idx long, image array<float>, label long")


@pytest.mark.parametrize("compression", ["none", "fp16", "int8", "topk"])
def test_federation_learns_and_agrees(spark, compression):
    samples = blobs(spark)
    test = samples.where("node_id = 0").select("sample_idx", "image", "label")
    options = federation.RunOptions(rounds=3, learning_rate=0.1, compression=compression, topk_ratio=0.5)
    out = federation.run(samples, topology.mesh_peers(spark.range(4)), nn.SoftmaxRegression(8, 4), options, test).collect()
    by = {(r["node_id"], r["tensor_id"]): r["values"] for r in out}
    if compression in ("none", "topk"):  # lossy wires differ from a node's own copy
        assert all(by[n, 0] == pytest.approx(by[0, 0], abs=1e-5) for n in range(4))
    assert [h["delta"] for h in options.history] == [False, compression == "topk", compression == "topk"]
    assert options.history[-1]["test"][0][1] > 0.9


def test_churn_makes_later_rounds_full(spark):
    options = federation.RunOptions(rounds=3, compression="topk", churn=0.5, churn_seed=7)
    federation.run(blobs(spark), topology.mesh_peers(spark.range(4)), nn.SoftmaxRegression(8, 4), options)
    lost = [h["dropped"] > 0 for h in options.history]
    assert any(lost) and not any(h["delta"] for h in options.history[lost.index(True) + 1 :])


def test_options_are_refused():
    for bad in ({"compression": "zip"}, {"eval_every": 0}, {"topk_ratio": 0.0}):
        with pytest.raises(RoundError):
            federation.RunOptions(**bad)


def test_npy_source(spark, tmp_path):
    rand = np.random.default_rng(2)
    for node in range(2):
        npy.save(str(tmp_path / f"node_{node:02d}_train_X.npy"), rand.random((10, 3, 2, 2)))
        npy.save(str(tmp_path / f"node_{node:02d}_train_y.npy"), np.arange(10), "<i8")
    npy.register(spark)
    df = spark.read.format("npy").option("rows", 4).option("shape", "3,2,2").load(str(tmp_path / "node_00_train_X.npy"))
    want = np.load(tmp_path / "node_00_train_X.npy").reshape(10, -1)
    assert df.rdd.getNumPartitions() == 3
    assert np.array_equal(np.array([r["values"] for r in df.orderBy("idx").collect()], np.float32), want)
    shards = npy.train_shards(spark, str(tmp_path))
    assert shards.count() == 20 and shards.where("sample_idx <> label").count() == 0
    np.save(tmp_path / "f8.npy", np.zeros(3))
    with pytest.raises(NpyError):
        npy.header(str(tmp_path / "f8.npy"))
    whole = (tmp_path / "node_00_train_y.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-1])
    with pytest.raises(NpyError):
        npy.header(str(tmp_path / "cut.npy"))
    out = spark.createDataFrame([("conv1B", [1.0, 2.0]), ("fcB", [3.0])], "name string, values array<float>")
    out.write.format("npy").mode("append").save(str(tmp_path / "weights"))
    assert np.load(tmp_path / "weights" / "conv1B.npy").tolist() == [1.0, 2.0]


def test_frames(spark):
    v = np.array([0.0, 1.5, -2.25, 0.0], dtype=np.float32)
    m = {"message_type": 0, "sender": 4294967295, "round": 3, "sample_count": 7,
         "tensors": [{"tensor_id": k, "encoding": k, "values": v.tolist()} for k in range(4)]}
    body = frames.encode(m)
    assert len(body) == 28 + 4 * 12 + 16 + (4 + 16) + 8 + (8 + 4)
    back = frames.decode(body)
    assert back["sender"] == m["sender"] and [t["values"] for t in back["tensors"][:3]] == [v.tolist()] * 3
    for cut in range(len(body)):
        with pytest.raises(CodecError):
            frames.decode(body[:cut])
    stream = frames.frame(m) * 2 + frames.frame(m)[:9]
    got, rest = frames.split(stream)
    assert got == [body, body] and rest == stream[-9:]
    df = spark.createDataFrame([(bytearray(frames.frame(m) + frames.frame(m)[:50]),)], "content binary")
    rows = frames.decode_frames(df).collect()
    assert len(rows) == 2 and rows[0]["tensors"][1]["values"] == v.tolist() and rows[1]["corrupt"]
    msgs = frames.decode_frames(df).where("corrupt is null").drop("corrupt")
    assert frames.decode_frames(frames.encode_frames(msgs)).first()["sample_count"] == 7


def test_smoke_message_is_56_bytes():
    m = {"message_type": 0, "sender": 1, "round": 0, "sample_count": 0, "tensors": [{"tensor_id": 0, "encoding": 0, "values": [1, 2, 3, 4]}]}
    assert len(frames.encode(m)) == 56


def test_round_log(spark, tmp_path):
    names = [x.split()[0] for x in ROUND_LOG.split(", ")]
    assert len(names) == 42
    row = spark.range(1).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ROUND_LOG.split(", ")])
    row = row.withColumns({"round": F.lit(1), "node_id": F.lit(2), "peak_rss_mb": F.lit(1.23456), "bytes_received": F.lit(-1).cast("long"),
                           "timestamp": F.expr("timestamp_ntz'2024-01-02T03:04:05'")})
    telemetry.write_round_log(row, str(tmp_path / "log"))
    text = next(p for p in (tmp_path / "log").iterdir() if p.name.startswith("part")).read_text()
    assert text.startswith(",".join(names)) and "2024-01-02T03:04:05" in text and ",1.235," in text
    back = telemetry.measured(telemetry.read_round_log(spark, str(tmp_path / "log"))).first()
    assert back["bytes_received"] is None and back["node_id"] == 2


def test_peer_events_and_config(spark, tmp_path):
    lines = [{"round": 1, "fromNode": 1, "toNode": 2, "bytes": 5, "pushDurationS": 0.1, "success": True, "timestamp": 1.5},
             {"round": 1, "fromNode": 1, "toNode": 3, "bytes": 5, "pushDurationS": 0.1, "success": False, "timestamp": 1.5, "kind": "timeout"}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)))
    events = telemetry.read_peer_events(spark, str(tmp_path / "e.jsonl"))
    assert sorted(r["kind"] for r in events.collect()) == ["push", "timeout"]
    assert telemetry.push_summary(events).first()["ok"] == 1
    telemetry.write_config({"b": 1, "a": 2}, str(tmp_path / "c.json"))
    assert (tmp_path / "c.json").read_text().index('"a"') < (tmp_path / "c.json").read_text().index('"b"')
    assert telemetry.usage()["peak_rss_mb"] > 0 and telemetry.system_state()["processors"] == os.cpu_count()


def stream(spark, tmp_path, parts, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_round_barrier(spark, tmp_path):
    schema = "receiver long, round long, sender long, sample_count long"
    parts = [[(0, 1, 1, 10), (0, 2, 1, 5), (0, 1, 9, 99), (7, 1, 1, 1)], [(0, 1, 1, 20), (0, 1, 2, 30)], [(0, 1, 2, 77), (0, 2, 2, 5)]]
    out = drain(collector.collect_rounds(stream(spark, tmp_path, parts, schema), {0: [1, 2]}), "barrier", tmp_path)
    by = {r["round"]: r for r in out}
    assert len(out) == 2 and by[1]["senders"] == [1, 2] and by[2]["status"] == "completed"
    assert by[1]["sample_count"] == 50  # 20 replaced 10, and 77 came after the round had closed


def poll(spark, df, name, tmp_path, enough, seconds=90, feed=lambda k: None):
    """Rows of a stream with processing-time timeouts: it always has a next batch to run, so processAllAvailable() would wait for ever."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").start()
    rows, stop, k = [], time.monotonic() + seconds, 0
    while not enough(rows) and time.monotonic() < stop:
        feed(k)
        k += 1
        time.sleep(0.5)
        rows = spark.sql(f"select * from {name}").collect()
    q.stop()
    return rows


def test_round_deadline(spark, tmp_path):
    """The deadline runs on over batches; a round without any message times out; nothing is left open after the last round."""
    schema = "receiver long, round long, sender long, sample_count long"
    df = stream(spark, tmp_path, [[(0, 1, 1, 10)], [(0, 1, 3, 30)], [(0, 3, 1, 1)]], schema)
    rows = poll(spark, collector.collect_rounds(df, {0: [1, 2, 3]}, deadline_ms=4000, last_round=3), "late", tmp_path, lambda rows: len(rows) >= 3)
    got = sorted((r["round"], r["status"], r["senders"], r["missing"]) for r in rows)
    assert got == [(1, "timed_out", [1, 3], [2]), (2, "timed_out", [], [1, 2, 3]), (3, "timed_out", [1], [2, 3])]


def test_frames_to_rounds(spark, tmp_path):
    """Files of frames under each receiver's folder become rounds; what cannot be read is left out."""
    folder = tmp_path / "mail"
    for receiver, sender, round_no, n in ((0, 1, 1, 10), (0, 2, 1, 20), (1, 2, 1, 20), (1, 0, 1, 5), (0, 1, 2, 10), (0, 2, 2, 20)):
        (folder / str(receiver)).mkdir(parents=True, exist_ok=True)
        m = {"message_type": 0, "sender": sender, "round": round_no, "sample_count": n, "tensors": [{"tensor_id": 0, "encoding": 0, "values": [1.0]}]}
        (folder / str(receiver) / f"{sender}-{round_no}.bin").write_bytes(frames.frame(m))
    (folder / "0" / "bad.bin").write_bytes(b"\x08\0\0\0rubbish!")
    out = drain(collector.rounds_of(spark, str(folder), {0: [1, 2], 1: [0, 2]}), "mail", tmp_path)
    assert sorted((r["receiver"], r["round"], r["status"], r["sample_count"]) for r in out) == [
        (0, 1, "completed", 30), (0, 2, "completed", 30), (1, 1, "completed", 25)
    ]


def test_silent_addresses_are_forgotten(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    df = collector.liveness(stream(spark, tmp_path, [[("a", t, True), ("b", t, False)]], "address string, at timestamp, up boolean"), forget_ms=1500)
    rows = poll(spark, df, "silent", tmp_path, lambda rows: len(rows) >= 2)
    assert [(r["address"], r["up"]) for r in rows] == [("a", True), ("a", False)]


def test_liveness_stream(spark, tmp_path):
    schema = "address string, at timestamp, up boolean"
    t = [datetime.datetime(2024, 1, 1, 0, 0, i) for i in range(6)]
    rows = [[("a", t[0], False), ("a", t[1], True), ("a", t[2], True), ("a", t[3], False), ("b", t[4], True)]]
    out = drain(collector.liveness(stream(spark, tmp_path, rows, schema)), "live", tmp_path)
    assert sorted((r["address"], r["up"]) for r in out) == [("a", False), ("a", True), ("b", True)]


def test_synthetic_batches(spark):
    rows = nn.synthetic(spark, 50, features=6, classes=10).orderBy("sample_idx").collect()
    assert len({tuple(r["image"]) for r in rows}) == 50 and all(0 <= v < 1 for r in rows for v in r["image"])
    rng = SplitMix64(42)
    for r in rows:  # one stream: the image's uniforms, then the label's draw, unsigned
        assert r["image"] == pytest.approx([(rng.next() >> 11) * 2.0**-53 for _ in range(6)], rel=1e-6) and r["label"] == rng.next() % 10


def plain_run(shards, links, rounds, rate, seed, compression="none", ratio=0.1, feedback=True, lost=(), late_s=None, dims=(8, 4)):
    """The round loop in numpy: (parameters by node, senders of deltas by round). ``lost``: (round, sender, receiver) that never arrive."""
    model = nn.SoftmaxRegression(*dims)
    params = {n: model.start(seed) for n in shards}
    stream_, base, owed, fallen, deltas = SplitMix64(seed), None, {}, set(), []
    stream_.next()
    for r in range(1, rounds + 1):
        s = stream_.next()
        own = {n: nn.epoch(params[n], x, y, s, rate, 32, accuracy=False)[0] for n, (x, y) in shards.items()}
        sent, mine, kind = {}, {}, {}
        for n in shards:
            kind[n] = compression == "topk" and n not in fallen and base is not None
            sent[n], mine[n], left = [], [], []
            for k, v in enumerate(own[n]):
                flat = v.reshape(-1)
                if kind[n]:
                    d = flat - base[n][k].reshape(-1)
                    if feedback and n in owed:
                        d = d + owed[n][k]
                    keep = max(1, int(np.floor(len(d) * ratio + 0.5)))
                    top = np.lexsort((np.arange(len(d)), -np.abs(d)))[:keep]
                    out = np.zeros_like(d)
                    out[top] = d[top]
                    left.append(d - out)
                    sent[n].append(out.reshape(v.shape))
                    mine[n].append(base[n][k] + out.reshape(v.shape))
                else:
                    sent[n].append(v.astype(np.float16).astype(np.float32) if compression == "fp16" else v)
                    mine[n].append(v)
            if kind[n]:
                owed[n] = left
        deltas.append(sorted(n for n in shards if kind[n]))
        merged = {}
        for n in shards:
            heard = [(n, mine[n])]
            for a, b in links:
                if b == n and (r, a, b) not in lost:
                    heard.append((a, [base[n][k] + v if kind[a] else v for k, v in enumerate(sent[a])]))
            total = sum(len(shards[a][1]) for a, _ in heard)
            merged[n] = [sum(len(shards[a][1]) * p[k].astype(np.float64) for a, p in heard) / total for k in range(len(mine[n]))]
            if any(b == n and (r, a, b) in lost for a, b in links):
                fallen.add(n)
        params = base = {n: [x.astype(np.float32) for x in p] for n, p in merged.items()}
    return params, deltas


def shards_of(samples):
    out = {}
    for r in samples.orderBy("node_id", "sample_idx").collect():
        out.setdefault(r["node_id"], []).append((r["image"], r["label"]))
    return {n: (np.array([x for x, _ in rows], np.float32), np.array([y for _, y in rows])) for n, rows in out.items()}


@pytest.mark.parametrize("case", ["mesh", "mesh-fp16", "mesh-topk", "ring-topk", "mesh-topk-lost", "ring-lost"])
def test_rounds_equal_a_plain_loop(spark, case):
    samples = blobs(spark, nodes=5)
    samples = samples.where("not (node_id = 3 and sample_idx >= 40)")  # unequal weights
    nodes = list(range(5))
    ring = [(a, (a + d) % 5) for a in nodes for d in (1, 4)]
    links = ring if "ring" in case else [(a, b) for a in nodes for b in nodes if a != b]
    lost = [(1, 0, 2), (2, 4, 1)] if "mesh" in case else [(2, 0, 1)]
    lost = lost if "lost" in case else []
    compression = "topk" if "topk" in case else "fp16" if "fp16" in case else "none"
    options = federation.RunOptions(
        rounds=3, learning_rate=0.1, compression=compression, topk_ratio=0.3, allow_sparse_delta=True, peer_deadline_s=5.0 if lost else None
    )
    arrivals = spark.createDataFrame([(r, a, b, 9.0 if r == 1 else None) for r, a, b in lost], "round int, sender long, receiver long, arrival_s double") if lost else None
    peers = spark.createDataFrame([(b, a) for a, b in links], "node_id long, peer_id long")
    out = federation.run(samples, peers, nn.SoftmaxRegression(8, 4), options, arrivals=arrivals).collect()
    want, deltas = plain_run(shards_of(samples), links, 3, 0.1, 42, compression, 0.3, lost=set(lost))
    assert [h["senders_of_deltas"] for h in options.history] == deltas
    assert [h["timed_out"] for h in options.history] == [sum(x[0] == r for x in lost) for r in (1, 2, 3)]
    for r in out:
        assert r["values"] == pytest.approx(want[r["node_id"]][r["tensor_id"]].reshape(-1).tolist(), abs=2e-5)


def test_run_writes_its_outputs(spark, tmp_path):
    """Startup exclusion, deadline, churn, logs, events, configuration and weights of one run."""
    samples = blobs(spark, nodes=5)
    test = samples.where("node_id = 0").select("sample_idx", "image", "label")
    seen = []
    options = federation.RunOptions(
        rounds=2, learning_rate=0.1, peer_deadline_s=2.0, startup_deadline_s=60.0, condition="peq_alpha_0p1", out=str(tmp_path / "out"), on_round=seen.append
    )
    ready = spark.createDataFrame([(n, 1.0) for n in range(4)] + [(4, 100.0)], "node_id long, ready_s double")
    arrivals = spark.createDataFrame([(1, 0, 1, 3.0), (2, 2, 3, None)], "round int, sender long, receiver long, arrival_s double")
    out = federation.run(samples, topology.mesh_peers(spark.range(5)), nn.SoftmaxRegression(8, 4), options, test, arrivals, ready)
    assert {r["node_id"] for r in out.select("node_id").collect()} == {0, 1, 2, 3} and [e["round"] for e in seen] == [1, 2]
    log = telemetry.read_round_log(spark, str(tmp_path / "out" / "rounds")).collect()
    by = {(r["round"], r["node_id"]): r for r in log}
    assert len(by) == 8 and by[1, 1]["status"] == "partial_peers_unreachable" and by[1, 1]["peers_timed_out"] == 1 and by[1, 0]["status"] == "completed"
    assert by[1, 0]["bytes_sent"] == 3 * (28 + 2 * 12 + 4 * 36) and by[1, 0]["bytes_received"] == -1 and by[2, 0]["test_acc"] > 0.9 and by[2, 0]["local_acc"] > 0.9
    assert by[1, 1]["gossip_wait_s"] == 2.0 and by[1, 1]["peers_expected"] == 3 and by[2, 3]["peers_reached"] == 2
    events = telemetry.read_peer_events(spark, str(tmp_path / "out" / "peer_events")).collect()
    kinds = {k: sum(e["kind"] == k for e in events) for k in ("push", "timeout", "excluded_at_startup")}
    assert kinds == {"push": 24, "timeout": 2, "excluded_at_startup": 4} and sum(e["kind"] == "push" and not e["success"] for e in events) == 2
    config = json.loads((tmp_path / "out" / "run_config.json").read_text())
    assert (config["family"], config["alpha"], config["iid"], config["rounds"]) == ("eq", 0.1, False, 2)
    weights = {r["tensor_id"]: r["values"] for r in out.where("node_id = 2").collect()}
    assert np.load(tmp_path / "out" / "weights" / "node_02" / "tensor_0.npy").tolist() == pytest.approx(weights[0])
    engine = Engine(spark)
    assert len(engine.summary(str(tmp_path / "out"))) == 4


def test_lost_push_without_a_deadline_is_an_error(spark):
    arrivals = spark.createDataFrame([(1, 0, 1, None)], "round int, sender long, receiver long, arrival_s double")
    with pytest.raises(RoundError):
        federation.run(blobs(spark), topology.mesh_peers(spark.range(4)), nn.SoftmaxRegression(8, 4), federation.RunOptions(rounds=1), arrivals=arrivals)
    options = federation.RunOptions.clamped(eval_every=0, topk_ratio=7.0)
    assert options.eval_every == 1 and options.topk_ratio == 1.0


def test_shards_are_checked_before_training(spark):
    for bad in (blobs(spark, n=20), blobs(spark).withColumn("image", F.slice("image", 1, 7)), blobs(spark).withColumn("label", F.col("label") + 1)):
        with pytest.raises(TrainerError):
            nn.guard(bad, nn.SoftmaxRegression(8, 4))
    with pytest.raises(TrainerError):
        nn.epoch([np.full((8, 4), np.nan, np.float32), np.zeros(4, np.float32)], np.ones((32, 8), np.float32), np.zeros(32, int), 1)


def test_engine(spark, tmp_path):
    rand = np.random.default_rng(8)
    folder = tmp_path / "data" / "iid"
    folder.mkdir(parents=True)
    for node in range(3):
        npy.save(str(folder / f"node_{node:02d}_train_X.npy"), rand.random((40, 3, 32, 32)))
        npy.save(str(folder / f"node_{node:02d}_train_y.npy"), rand.integers(0, 10, 40), "<i8")
    npy.save(str(folder / "test_X.npy"), rand.random((32, 3, 32, 32)))
    npy.save(str(folder / "test_y.npy"), rand.integers(0, 10, 32), "<i8")
    top = {"nodes": [{"id": f"pi-{i}", "host": "h", "port": 9000 + i} for i in (1, 2, 3)], "links": [{"source": "pi-1", "target": "pi-2"}, {"source": "pi-2", "target": "pi-9"}]}
    (tmp_path / "t.json").write_text(json.dumps(top))
    engine = Engine(spark)
    engine.test_aggregator()
    losses = engine.test_cnn(steps=3)
    assert 1.8 < losses[0] < 3 and losses[-1] < losses[0]
    options = federation.RunOptions(rounds=1, out=str(tmp_path / "out"))
    out = engine.run_round(str(tmp_path / "t.json"), str(tmp_path / "data"), options, mode="file", local_id="pi-1").collect()
    assert len(out) == 24 and np.load(tmp_path / "out" / "weights" / "node_00" / "conv1W.npy").shape == (432,)
    same = {n: [r["values"] for r in sorted(out, key=lambda r: r["tensor_id"]) if r["node_id"] == n] for n in range(3)}
    assert same[0] == same[1] != same[2]  # pi-1 and pi-2 are linked, pi-3 is alone
    for kw in ({"local_id": "pi-8"}, {"mode": "star"}):
        with pytest.raises(TopologyError):
            engine.run_round(str(tmp_path / "t.json"), str(tmp_path / "data"), options, **kw)
    info = engine.inspect_npy(str(folder / "node_00_train_X.npy"))
    x = np.load(folder / "node_00_train_X.npy")
    assert info["shape"] == (40, 3, 32, 32) and info["count"] == x.size and info["mean"] == pytest.approx(float(x.mean()), abs=1e-4) and info["first"] == pytest.approx(x.reshape(-1)[:5].tolist())
    shard = engine.inspect_shard(str(folder), 1, strategy="eager")
    assert shard["samples"] == 40 and shard["features"] == 3072 and sum(shard["labels"].values()) == 40
    assert len(engine.train_cnn(str(folder), 2, epochs=2)) == 2


def test_npy_writer_and_pairs(spark, tmp_path):
    npy.register(spark)
    where = str(tmp_path / "w")
    spark.createDataFrame([("a", [2**53 + 1, 2]), ("old", [1])], "name string, values array<bigint>").write.format("npy").mode("append").save(where)
    assert np.load(f"{where}/a.npy").tolist() == [2**53 + 1, 2] and np.load(f"{where}/a.npy").dtype == np.int64
    spark.createDataFrame([("a", [1.5])], "name string, values array<float>").write.format("npy").mode("overwrite").save(where)
    assert sorted(os.listdir(where)) == ["a.npy"] and np.load(f"{where}/a.npy").tolist() == [1.5]
    x, y = (spark.createDataFrame([(i, i) for i in ids], f"k long, {name} long") for ids, name in (((1, 2), "image"), ((2, 3), "label")))
    with pytest.raises(Exception, match="differ at"):
        npy.paired(x, y, ["k"]).collect()
    assert npy.paired(x, x.withColumnRenamed("image", "label"), ["k"]).count() == 2
    with pytest.raises(Exception, match="is expected"):
        spark.read.format("npy").option("dtype", "<i8").load(f"{where}/a.npy").collect()


def test_int8_halves_are_the_codec_s(spark):
    """A step of 0.49999997 is level 0 in frames as in the column codec."""
    v = np.array([0.0, 0.49999997, 0.5, 1.5, 254.49998, 255.0], dtype=np.float32)
    body = frames.encode({"message_type": 0, "sender": 1, "round": 1, "sample_count": 1, "tensors": [{"tensor_id": 0, "encoding": 3, "values": v.tolist()}]})
    assert list(body[-6:]) == [0, 0, 1, 2, 254, 255]
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select(F.col("v").cast("float").alias("v"))
    q = codec.int8_quantise(F.col("v"), F.lit(0.0).cast("float"), F.lit(1.0).cast("float"))
    assert [r["q"] for r in rows.select("v", q.alias("q")).orderBy("v").collect()] == [0, 0, 1, 2, 254, 255]


def test_sparse_entries_out_of_order(spark):
    rows = [([(3, 1.0), (0, 2.0), (3, 5.0), (9, 7.0), (-1, 8.0)],), ([],)]
    df = spark.createDataFrame(rows, "e array<struct<idx:int,value:float>>").select(codec.sparse_to_dense(F.col("e"), 5).alias("v"))
    assert [r["v"] for r in df.collect()] == [[2.0, 0.0, 0.0, 5.0, 0.0], [0.0] * 5]
