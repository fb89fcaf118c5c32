"""Global order over any number of partitions, and reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session takes a temporary folder; on a cluster, whose
    machines would not see it, that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="peerloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``__pl_pos``: the 0-based rank of each row in the global order of ``keys``.

    One range shuffle, which also splits a key that holds a third of the rows
    as long as the later keys tell its rows apart. The rows are checkpointed
    with their place inside their partition, so the offsets of the partitions
    (one number each, the only thing broadcast) refer to the same layout.
    """
    laid = durable(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("__pl_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("__pl_mid", 33)
    sizes = laid.groupBy(part.alias("__pl_part")).agg(F.count(F.lit(1)).alias("__pl_n"))
    offsets = sizes.select(
        "__pl_part",
        F.coalesce(
            F.sum("__pl_n").over(Window.orderBy("__pl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__pl_off"),
    )
    return (
        laid.withColumn("__pl_part", part)
        .join(F.broadcast(offsets), "__pl_part")
        .withColumn("__pl_pos", F.col("__pl_off") + F.col("__pl_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__pl_part", "__pl_off", "__pl_mid")
    )
