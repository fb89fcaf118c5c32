"""The entry points: a round run, inspections of files, and the built-in checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import PeerloomError
from .operators import aggregate, topology
from .plans import federation, nn
from .sources import npy, telemetry


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        npy.register(spark)

    def run_round(
        self,
        topology_path: str,
        data: str,
        options: federation.RunOptions,
        mode: str = "full-mesh",
        model: nn.Model | None = None,
        local_id: str | None = None,
        arrivals: DataFrame | None = None,
        ready: DataFrame | None = None,
    ) -> DataFrame:
        """Final parameters of all nodes of a topology file, trained on the shards under ``<data>/<condition>``.

        The i-th node of the file trains on ``node_<i>_train``; node_id is that position.
        """
        nodes, links = topology.load(self.spark, topology_path, local_id)
        place = nodes.select("id", F.col("node_idx").cast("long").alias("node_idx"))
        peers = topology.peers_of(nodes, links, mode)
        peers = peers.join(place.withColumnsRenamed({"id": "node_id", "node_idx": "a"}), "node_id").join(
            place.withColumnsRenamed({"id": "peer_id", "node_idx": "b"}), "peer_id"
        ).select(F.col("a").alias("node_id"), F.col("b").alias("peer_id"))
        folder = f"{data}/{options.condition}"
        shards = npy.train_shards(self.spark, folder).join(F.broadcast(place), "node_idx", "left_semi")
        samples = shards.withColumn("node_id", F.col("node_idx").cast("long")).select("node_id", "sample_idx", "image", "label")
        test = npy.test_set(self.spark, folder)
        return federation.run(samples, peers, model or nn.ConvNet(), options, test, arrivals, ready)

    def inspect_npy(self, path: str, first: int = 5, strategy: str = "mapped") -> dict:
        """Type, shape, count, least, greatest, mean, number of different values and the first ones of an array."""
        descr, shape, _ = npy.header(path)
        rows = self.spark.read.format("npy").option("strategy", strategy).load(path)
        values = rows.select("idx", F.posexplode("values").alias("at", "v")) if descr == "<f4" else rows.select("idx", F.lit(0).alias("at"), F.col("label").alias("v"))
        s = values.agg(
            F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(F.col("v").cast("double")).alias("mean"),
            F.count_distinct("v").alias("distinct"),
        ).first()
        head = [r["v"] for r in values.orderBy("idx", "at").limit(first).collect()]
        return {"dtype": descr, "shape": shape, **s.asDict(), "first": head}

    def inspect_shard(self, folder: str, node: int, strategy: str = "mapped") -> dict:
        """Samples, numbers of an image, their range, and the labels of one node's shard."""
        shard = npy.train_shards(self.spark, folder, node, strategy)
        s = shard.agg(
            F.count(F.lit(1)).alias("samples"), F.min(F.size("image")).alias("features"), F.min(F.array_min("image")).alias("min"),
            F.max(F.array_max("image")).alias("max"),
        ).first()
        labels = {r["label"]: r["count"] for r in shard.groupBy("label").count().collect()}
        return {**s.asDict(), "labels": dict(sorted(labels.items()))}

    def train_cnn(self, folder: str, node: int, epochs: int = 1, learning_rate: float = 0.01, seed: int = 42, model: nn.Model | None = None) -> list[dict]:
        """Metrics of each epoch of one node alone; momentum and the random stream start anew with each."""
        model = model or nn.ConvNet()
        shard = npy.train_shards(self.spark, folder, node).select(F.lit(node).cast("long").alias("node_id"), "sample_idx", "image", "label").persist()
        nn.guard(shard, model)
        params, out = self.spark.createDataFrame(nn.pack(node, model.start(seed)), nn.PARAM_ROWS), []
        for _ in range(epochs):
            trained = federation.durable(nn.train_nodes(shard, params, model, seed, learning_rate))
            out.append(trained.where("tensor_id = 0").drop("values", "tensor_id").first().asDict())
            params = trained.select("node_id", "tensor_id", "values")
        shard.unpersist()
        return out

    def test_cnn(self, steps: int = 4, n: int = 32, learning_rate: float = 0.01, seed: int = 42) -> list[float]:
        """Losses on one synthetic batch: the first is near ln(classes), and they fall."""
        model = nn.ConvNet()
        batch = nn.synthetic(self.spark, n, seed, model.features, model.classes)
        samples = federation.durable(batch.select(F.lit(0).cast("long").alias("node_id"), "sample_idx", "image", "label"))
        params, losses = self.spark.createDataFrame(nn.pack(0, model.start(seed)), nn.PARAM_ROWS), []
        for _ in range(steps):
            trained = federation.durable(nn.train_nodes(samples, params, model, seed, learning_rate))
            losses.append(trained.first()["train_loss"])
            params = trained.select("node_id", "tensor_id", "values")
        return losses

    def test_aggregator(self) -> None:
        """The average's known answers; raises where one is off by over 0.001."""
        # Cases as (samples, parameters) of each update, the local one first, and the result.
        ten = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
        cases = [
            ([(10, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (20, ten), (30, [10 * x for x in ten])], [53.5, 107.0, 160.5, 214.0, 267.5, 321.0]),
            ([(1, [2.0, 4.0, 6.0, 8.0]), (1, [10.0] * 4)], [6.0, 7.0, 8.0, 9.0]),
            ([(5, [1.0, 2.0, 3.0])], [1.0, 2.0, 3.0]),
            ([(0, [1.0, 2.0]), (0, [3.0, 4.0])], [1.0, 2.0]),
        ]
        rows = [(k, u == 0, n, i, v) for k, (case, _) in enumerate(cases) for u, (n, values) in enumerate(case) for i, v in enumerate(values)]
        df = self.spark.createDataFrame(rows, "id int, own boolean, sample_count long, idx int, value double")
        got = aggregate.average_or_local(df, df.where("own").select("id", "idx", "value"), ["id", "idx"]).collect()
        found = {(r["id"], r["idx"]): r["value"] for r in got}
        for k, (_, want) in enumerate(cases):
            if any(abs(found[k, i] - x) > 0.001 for i, x in enumerate(want)):
                raise PeerloomError(f"case {k}: {[found[k, i] for i in range(len(want))]} is not {want}")

    def summary(self, out: str) -> list[str]:
        """One line for each node of a finished run."""
        return [r["line"] for r in telemetry.summary_line(telemetry.read_round_log(self.spark, f"{out}/rounds")).orderBy("node_id").collect()]
