import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerloom.errors import RoundError
from peerloom.functions import codec, rng, scalars
from peerloom.operators import aggregate, rounds, topology


def test_splitmix_golden():
    r = rng.SplitMix64(42)
    assert [r.next() for _ in range(4)] == [13679457532755275413, 2949826092126892291, 5139283748462763858, 6349198060258255764]
    assert rng.SplitMix64(42).permutation(10) == [0, 9, 5, 8, 6, 4, 7, 2, 1, 3]


@given(st.integers(0, 2**64 - 1))
def test_permutation_is_a_bijection(seed):
    assert sorted(rng.SplitMix64(seed).permutation(33)) == list(range(33))


def test_column_stream_equals_driver_stream(spark):
    seeds = [0, 1, 42, 2**63 - 1, 2**63, 2**64 - 1, 123456789123456789]
    df = spark.createDataFrame([(str(s), rng.signed(s)) for s in seeds], "s string, seed long")
    out = df.select("s", *[rng.unsigned_text(rng.output(F.col("seed"), k)).alias(f"o{k}") for k in (1, 2, 3)]).collect()
    for row in out:
        r = rng.SplitMix64(int(row["s"]))
        assert [int(row[f"o{k}"]) for k in (1, 2, 3)] == [r.next() for _ in range(3)]


def test_churn_golden(spark):
    grid = spark.range(1, 6).select(F.col("id").alias("round")).crossJoin(spark.range(1, 11).select(F.col("id").alias("peer")))
    got = grid.where(rounds.churn_dropped(7, F.col("round"), F.col("peer"), 0.3)).collect()
    by = {r: sorted(x["peer"] for x in got if x["round"] == r) for r in range(1, 6)}
    assert by == {1: [1, 2, 9, 10], 2: [3], 3: [8], 4: [3, 7, 8, 10], 5: [5, 8, 9, 10]}


def test_fp16_equals_numpy(spark):
    rand = np.random.default_rng(1)
    v = np.concatenate([rand.normal(0, s, 300) for s in (1e-8, 1e-6, 1e-3, 1, 1e3, 5e4)] + [[0, -0.0, 65504, 65519, 65520, -7e4, 6e-8]])
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v float")
    got = np.array([r[0] for r in df.orderBy("i").select(codec.fp16_roundtrip(F.col("v"))).collect()], dtype=np.float32)
    with np.errstate(over="ignore"):
        assert np.array_equal(got, v.astype(np.float16).astype(np.float32))


def test_int8_golden(spark):
    v = [-0.5, -0.1, 0.0, 0.2, 0.45]
    df = spark.createDataFrame([(x,) for x in v], "v float").withColumns({"low": F.lit(-0.5).cast("float"), "high": F.lit(0.45).cast("float")})
    df = df.withColumn("s", codec.int8_scale(F.col("low"), F.col("high")))
    df = df.withColumn("q", codec.int8_quantise(F.col("v"), F.col("low"), F.col("s")))
    rows = df.withColumn("back", codec.int8_dequantise(F.col("q"), F.col("low"), F.col("s"))).orderBy("v").collect()
    assert [r["q"] for r in rows] == [0, 107, 134, 188, 255]
    assert [r["back"] for r in rows] == pytest.approx([-0.5, -0.10137257, -0.00078434, 0.20039213, 0.45], abs=1e-7)


def test_sparse_round_trip(spark):
    df = spark.createDataFrame([([0.0, 1.5, -0.0, float("nan"), -2.0],)], "v array<float>")
    back = df.select(codec.sparse_to_dense(codec.sparse_entries(F.col("v")), 5).alias("v")).first()["v"]
    assert back[:3] == [0.0, 1.5, 0.0] and np.isnan(back[3]) and back[4] == -2.0
    odd = spark.createDataFrame([([(1, 1.0), (9, 5.0), (1, 2.0)],)], "e array<struct<idx:int,value:float>>")
    assert odd.select(codec.sparse_to_dense(F.col("e"), 3).alias("v")).first()["v"] == [0.0, 2.0, 0.0]


def test_message_bytes_of_the_network(spark):
    from peerloom.schemas import TENSORS

    def total(encoding):
        rows = [(0, encoding, n, codec_k) for _, n in TENSORS for codec_k in [max(1, int(n * 0.1 + 0.5))]]
        return codec.message_bytes(spark.createDataFrame(rows, "m int, encoding int, n int, nnz int"), ["m"]).first()["wire_bytes"]

    assert [total(e) for e in (codec.DENSE, codec.FP16, codec.INT8, codec.SPARSE)] == [104740, 52432, 26342, 21076]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-10, 10, width=32), min_size=1, max_size=20), st.integers(1, 20))
def test_topk_and_residual_add_up(spark, values, k):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "t int, idx int, value float")
    rows = codec.residual(codec.top_k(df, ["t"], k)).collect()
    assert sum(r["kept"] for r in rows) == min(k, len(values))
    assert all((r["value"] if r["kept"] else 0.0) + r["residual"] == r["value"] for r in rows)
    low = min(abs(r["value"]) for r in rows if r["kept"])
    assert all(abs(r["value"]) <= low for r in rows if not r["kept"])


@pytest.mark.parametrize(
    "updates,expected",
    [
        ([(10, [1, 2, 3, 4, 5, 6]), (20, [10, 20, 30, 40, 50, 60]), (30, [100, 200, 300, 400, 500, 600])], [53.5, 107, 160.5, 214, 267.5, 321]),
        ([(1, [2, 4, 6, 8]), (1, [10, 10, 10, 10])], [6, 7, 8, 9]),
        ([(5, [1, 2, 3])], [1, 2, 3]),
    ],
)
def test_weighted_average_golden(spark, updates, expected):
    df = spark.createDataFrame([(0, n, [float(x) for x in v]) for n, v in updates], "t int, sample_count long, values array<float>")
    long = df.select("t", "sample_count", F.posexplode("values").alias("idx", "value"))
    got = [r["value"] for r in aggregate.weighted_average(long, ["t", "idx"]).orderBy("idx").collect()]
    assert got == pytest.approx(expected, abs=1e-3)


def test_zero_samples_keep_the_local_value(spark):
    local = spark.createDataFrame([(0, 0, 3.0)], "t int, idx int, value double")
    u = spark.createDataFrame([(0, 0, 9.0, 0), (0, 0, 1.0, 0)], "t int, idx int, value double, sample_count long")
    assert aggregate.average_or_local(u, local, ["t", "idx"]).first()["value"] == 3.0


def test_nan_is_not_chosen(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0, 3.0],)], "z array<double>")
    row = df.select(scalars.argmax_first(F.col("z")).alias("a"), scalars.relu(F.get("z", F.lit(1))).alias("r")).first()
    assert (row["a"], row["r"]) == (2, 0.0)


def test_node_id_refuses_other_names(spark):
    df = spark.createDataFrame([("pi-x",)], "n string")
    with pytest.raises(Exception, match="no node number"):
        df.select(scalars.numeric_node_id(F.col("n"))).collect()


def test_delta_without_base_is_an_error(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "t int, idx int, value double")
    with pytest.raises(Exception, match="different elements"):
        rounds.apply_delta(d, d.where("idx = 0"), ["t"]).collect()


def test_sparse_topology_refuses_deltas(spark):
    nodes = spark.range(4)
    ring = topology.link_peers(nodes, nodes.select(F.col("id").alias("source"), ((F.col("id") + 1) % 4).alias("target")))
    with pytest.raises(RoundError):
        rounds.require_mesh(ring, "topk")
    rounds.require_mesh(topology.mesh_peers(nodes), "topk")


def test_topology_file(spark, tmp_path):
    import json

    nodes = [{"id": f"pi-{i}", "host": "127.0.0.1", "port": 9000 + i} for i in range(1, 11)]
    links = [{"source": f"pi-{i}", "target": f"pi-{i % 10 + 1}"} for i in range(1, 11)] + [{"source": "pi-1", "target": "pi-99"}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"nodes": nodes, "links": links}, indent=1))
    n, k = topology.load(spark, str(path))
    assert topology.mesh_peers(n).count() == 90 and topology.link_peers(n, k).count() == 20
    assert [r["id"] for r in topology.unknown_ids(n, k).collect()] == ["pi-99"]
    path.write_text(json.dumps({"nodes": nodes + nodes[:1], "links": []}))
    with pytest.raises(Exception, match="repeated"):
        topology.load(spark, str(path))
