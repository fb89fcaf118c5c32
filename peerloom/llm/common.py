"""Helpers that the operators share: durable checkpoints, global order, components.

Texts never pass through the helpers that shuffle. Internal columns start with ``__pl_`` so that a caller's extra
columns cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order import durable, shared_folder, with_position

__all__ = ["durable", "shared_folder", "with_position"]

#: Bytes that end a word: space and 0x09-0x0D. ``bytes.split()`` splits on these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared checkpoint folder, which takes far less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def tokens_of(text) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def with_running_sum(df: DataFrame, group: list[str], keys: list[str], value: str) -> DataFrame:
    """Add ``__pl_cum``: the sum of the long ``value`` up to and with each row, within ``group``, in the order of ``keys``.

    The rows of one group may fill any number of partitions: each partition
    sums its own rows, and only one total for each partition and group is
    shared. Rows with equal keys come in any order: keys should be distinct.
    """
    part = F.shiftright("__pl_mid", 33).alias("__pl_part")
    laid = durable(
        df.repartitionByRange(*[F.col(k) for k in [*group, *keys]])
        .sortWithinPartitions(*group, *keys)
        .withColumn("__pl_mid", F.monotonically_increasing_id())
    ).withColumn("__pl_part", part)
    own = Window.partitionBy("__pl_part", *group).orderBy("__pl_mid").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__pl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy("__pl_part", *group)
        .agg(F.sum(value).alias("__pl_sum"))
        .select("__pl_part", *group, F.coalesce(F.sum("__pl_sum").over(before), F.lit(0)).alias("__pl_off"))
    )
    return (
        laid.withColumn("__pl_local", F.sum(value).over(own))
        .join(offsets, ["__pl_part", *group])
        .withColumn("__pl_cum", F.col("__pl_local") + F.col("__pl_off"))
        .drop("__pl_part", "__pl_local", "__pl_off", "__pl_mid")
    )


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a spanning forest in star form (same components)."""

    def forest(batches):
        import pandas as pd

        root: dict[int, int] = {}

        def find(x):
            r = x
            while root.get(r, r) != r:
                r = root[r]
            while root.get(x, x) != r:
                root[x], x = r, root[x]
            return r

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                ra, rb = find(a), find(b)
                if ra != rb:
                    low, high = (ra, rb) if ra < rb else (rb, ra)
                    root[high] = low
        out = [(x, find(x)) for x in list(root)]
        for i in range(0, len(out), 50_000):
            yield pd.DataFrame(out[i : i + 50_000], columns=["a", "b"]).astype("int64")

    return edges.mapInPandas(forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of long ``a``-``b`` edges: ``node``, ``component`` (its smallest node).

    Alternating large-star and small-star steps on edge tables, checkpointed
    each round, after each partition has reduced its own edges to a spanning
    forest. Nodes without an edge to another node are absent.
    """
    e = edges.where("a <> b and a is not null and b is not null").select("a", "b")
    e = durable(spanning_forest(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("__pl_m")).select("a", F.least("a", "__pl_m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
            .select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        e = durable(small)
        # A forest of stars: every node has one edge, and no centre is another's leaf.
        open_ends = e.join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not open_ends:
            many = e.groupBy("a").count().where("count > 1").limit(1).count()
            if not many:
                break
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows of ``df`` (all, if it has fewer; never above ``n``), picked by the hash of ``key``.

    Only hashes are sorted: the rows themselves stay where they are and are taken by the
    largest hash that is in (rows of equal hash are in or out together).
    """
    h = F.xxhash64(F.col(key))
    rate = max(1, df.count() // (2 * n))  # so that no task hands on more than its share of about 2n hashes
    df = df.where(F.pmod(h, F.lit(rate)) == 0)
    hashes = df.groupBy(h.alias("__pl_h")).agg(F.count(F.lit(1)).alias("__pl_n"))
    least = hashes.orderBy("__pl_h").limit(n).collect()
    left, top = n, None
    for r in least:
        left -= r["__pl_n"]
        if left < 0:
            break
        top = r["__pl_h"]
    return df.where(h <= F.lit(top)) if top is not None else df.limit(0)
