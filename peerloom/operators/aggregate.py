"""Weighted averaging of parameters, and counters over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_average(updates: DataFrame, keys: list[str], value: str = "value", weight: str = "sample_count") -> DataFrame:
    """``keys``, ``value``: sum(weight * value) / sum(weight) in double; null where all weights are zero."""
    w = F.col(weight).cast("double")
    total = F.sum(w)
    return updates.groupBy(*keys).agg(F.when(total != 0, F.sum(w * F.col(value)) / total).alias(value))


def average_or_local(updates: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """As ``weighted_average``, but a receiver whose samples add up to zero keeps its ``local`` value."""
    return (
        local.withColumnRenamed("value", "local")
        .join(weighted_average(updates, keys), keys, "left")
        .select(*keys, F.coalesce("value", "local").alias("value"))
    )


def counters(status: DataFrame, keys: list[str]) -> DataFrame:
    """Peers reached, expected, timed out and dropped, and the round's status."""
    is_ = lambda s: F.count_if(F.col("status") == s).cast("int")
    return status.groupBy(*keys).agg(
        is_("arrived").alias("peers_reached"),
        F.count(F.lit(1)).cast("int").alias("peers_expected"),
        is_("timed_out").alias("peers_timed_out"),
        is_("churn_dropped").alias("peers_churn_dropped"),
        F.when(F.bool_and(~F.col("status").isin("timed_out", "churn_dropped")), "completed")
        .otherwise("partial_peers_unreachable")
        .alias("round_status"),
    )


def last_write(messages: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Of several messages with the same keys the last by ``order`` counts."""
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("m")
    return messages.groupBy(*keys).agg(best).select(*keys, *[F.col(f"m.{c}").alias(c) for c in cols])


def effective_cores(cpu_seconds: Column, wall_seconds: Column) -> Column:
    return F.when(wall_seconds > 0, cpu_seconds / wall_seconds).otherwise(F.lit(0.0))


def realised_ratio(wire: Column, payload: Column) -> Column:
    """Wire bytes by payload bytes over a group, rounds that were not instrumented left out."""
    return F.sum(F.nullif(wire, F.lit(-1))) / F.sum(F.nullif(payload, F.lit(-1)))
