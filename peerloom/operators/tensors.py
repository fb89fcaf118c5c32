"""Relational tensor kernels on long tables (one row an element). They check the numpy kernels of ``plans.nn``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(i, k, value) times (k, j, value): a join on k, then a sum."""
    on = [*(keys or []), "k"]
    return (
        a.withColumnRenamed("value", "va")
        .join(b.withColumnRenamed("value", "vb"), on)
        .groupBy(*(keys or []), "i", "j")
        .agg(F.sum(F.col("va") * F.col("vb")).alias("value"))
    )


def transpose(m: DataFrame) -> DataFrame:
    swap = {"i": "j", "j": "i"}
    return m.select(*[F.col(c).alias(swap.get(c, c)) for c in m.columns])


def im2col(pixels: DataFrame, keys: list[str], size: int, kernel: int, pad: int = 0) -> DataFrame:
    """Patches (oh, ow, kh, kw, value) of square pictures (y, x, value); padding reads zero."""
    out = size + 2 * pad - kernel + 1
    grid = F.sequence(F.lit(0), F.lit(kernel - 1))
    spread = (
        pixels.withColumn("kh", F.explode(grid))
        .withColumn("kw", F.explode(grid))
        .withColumn("oh", F.col("y") + pad - F.col("kh"))
        .withColumn("ow", F.col("x") + pad - F.col("kw"))
        .where(F.col("oh").between(0, out - 1) & F.col("ow").between(0, out - 1))
    )
    return spread.select(*keys, "oh", "ow", "kh", "kw", "value")


def col2im(patches: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Scatter-add of patches back to their pixels."""
    y, x = F.col("oh") + F.col("kh") - pad, F.col("ow") + F.col("kw") - pad
    return patches.groupBy(*keys, y.alias("y"), x.alias("x")).agg(F.sum("value").alias("value"))


def conv(pixels: DataFrame, weights: DataFrame, keys: list[str], size: int, kernel: int, pad: int = 0) -> DataFrame:
    """Convolution: patches joined with (kh, kw, w) and summed."""
    return (
        im2col(pixels, keys, size, kernel, pad)
        .join(F.broadcast(weights), ["kh", "kw"])  # kernel * kernel rows
        .groupBy(*keys, "oh", "ow")
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    )


def max_pool(pixels: DataFrame, keys: list[str], size: int) -> DataFrame:
    """2 by 2 pooling with stride 2 (an odd last row or column is left out); NaN is never the maximum.

    One row a pixel of a full window: its window (oh, ow), the window's maximum and the share of the
    gradient that the pixel gets. Tied maxima share it evenly.
    """
    even = size // 2 * 2
    inside = pixels.where((F.col("y") < even) & (F.col("x") < even)).withColumns(
        {"oh": F.floor(F.col("y") / 2).cast("int"), "ow": F.floor(F.col("x") / 2).cast("int")}
    )
    top = inside.where(~F.isnan("value")).groupBy(*keys, "oh", "ow").agg(F.max("value").alias("top"))
    both = inside.join(top, [*keys, "oh", "ow"])
    count = both.where("value = top").groupBy(*keys, "oh", "ow").agg(F.count(F.lit(1)).alias("ties"))
    return both.join(count, [*keys, "oh", "ow"]).withColumn(
        "share", F.when(F.col("value") == F.col("top"), 1.0 / F.col("ties")).otherwise(F.lit(0.0))
    )


def sgd_step(w, v, g, rate: float, momentum: float = 0.9):
    """(new weight, new velocity) of momentum SGD as columns."""
    nv = momentum * v - rate * g
    return w + nv, nv
