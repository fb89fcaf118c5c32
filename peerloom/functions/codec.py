"""Tensor encodings as column expressions: half floats, 8-bit affine, top-k, sparse, and their byte costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rng import let

# Encodings by number, and the header sizes of a message and a tensor in bytes.
DENSE, SPARSE, FP16, INT8 = 0, 1, 2, 3
ENCODINGS = {DENSE: "dense", SPARSE: "sparse", FP16: "fp16", INT8: "int8"}
MESSAGE_BYTES, TENSOR_BYTES = 28, 12


def fp16_roundtrip(v: Column) -> Column:
    """IEEE half precision and back, nearest even, with subnormals and overflow to infinity."""
    d = v.cast("double")
    q = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14)) - 10)
    return (
        F.when(d.isNull() | F.isnan(d) | (d == 0), d)
        .when(F.abs(d) >= 65520, F.signum(d) * F.lit(float("inf")))
        .otherwise(F.rint(d / q) * q)
        .cast("float")
    )


def int8_scale(low: Column, high: Column) -> Column:
    span = (high - low).cast("float")
    return F.when(span > 0, (span / F.lit(255.0).cast("float")).cast("float")).otherwise(F.lit(1.0).cast("float"))


def int8_quantise(v: Column, low: Column, scale: Column) -> Column:
    """Level 0 to 255, halves away from zero, each step in single precision."""
    step = (((v - low).cast("float")) / scale).cast("float")
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(step.cast("double")).cast("int")))


def int8_dequantise(q: Column, low: Column, scale: Column) -> Column:
    return (low + (q.cast("float") * scale).cast("float")).cast("float")


def payload_bytes(encoding: Column, n: Column, nnz: Column) -> Column:
    return (
        F.when(encoding == DENSE, 4 * n).when(encoding == FP16, 2 * n).when(encoding == INT8, 8 + n).otherwise(4 + 8 * nnz)
    )


def message_bytes(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """wire_bytes and payload_bytes (what the message would take if dense) for each message; tensors has encoding, n, nnz."""
    cost = payload_bytes(F.col("encoding"), F.col("n"), F.col("nnz")) + TENSOR_BYTES
    return tensors.groupBy(*keys).agg(
        (F.sum(cost) + MESSAGE_BYTES).cast("long").alias("wire_bytes"),
        (F.sum(4 * F.col("n") + TENSOR_BYTES) + MESSAGE_BYTES).cast("long").alias("payload_bytes"),
    )


def keep_count(n: Column, ratio: float) -> Column:
    """How many entries top-k keeps: at least one, halves away from zero."""
    return F.least(n, F.greatest(F.lit(1), F.round(n * F.lit(ratio)).cast("int")))


def top_k(entries: DataFrame, keys: list[str], k: Column | int) -> DataFrame:
    """Add ``kept``: whether an entry is among the k largest by magnitude of its tensor (ties: lower idx)."""
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), F.col("idx"))
    return entries.withColumn("kept", F.row_number().over(w) <= k)


def residual(entries: DataFrame) -> DataFrame:
    """What top-k leaves behind: kept places are zero."""
    return entries.withColumn("residual", F.when(F.col("kept"), F.lit(0.0).cast("float")).otherwise(F.col("value")))


def sparse_entries(values: Column) -> Column:
    """(idx, value) of the entries that are not zero; NaN counts, minus zero does not."""
    pairs = F.transform(values, lambda v, i: F.struct(i.alias("idx"), v.alias("value")))
    return F.filter(pairs, lambda e: (e["value"] != 0) | F.isnan(e["value"]))


def sparse_to_dense(entries: Column, n: int) -> Column:
    """Zeros but for the entries; an idx out of range is ignored and of equal ones the last counts.

    One sort and one pass: the entries in the order of idx fill the gaps between them with zeros.
    """
    zero, none = F.lit(0.0).cast("float"), F.array().cast("array<float>")
    gap = lambda k: F.when(k > 0, F.array_repeat(zero, k.cast("int"))).otherwise(none)
    at = lambda p, i: F.get(p, i)["idx"]
    # (idx, place) in order, so that the last of equal ones is next to a greater idx.
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["idx"].cast("int").alias("idx"), i.alias("at"), e["value"].cast("float").alias("value"))))
    last = let(placed, lambda p: F.filter(p, lambda e, i: (e["idx"] >= 0) & (e["idx"] < n) & F.coalesce(at(p, i + 1) != e["idx"], F.lit(True))))

    def fill(p):
        parts = F.transform(p, lambda e, i: F.concat(gap(e["idx"] - F.coalesce(at(p, i - 1), F.lit(-1)) - 1), F.array(e["value"])))
        return F.concat(F.flatten(parts), gap(n - 1 - F.coalesce(at(p, F.size(p) - 1), F.lit(-1))))

    return let(last, fill)


def is_lossy(encoding: Column) -> Column:
    return encoding != DENSE


def int8_roundtrip(v: Column, low: Column, high: Column) -> Column:
    scale = int8_scale(low, high)
    return int8_dequantise(int8_quantise(v, low, scale), low, scale)


#: What a receiver reads of a value, by the round loop's name of the encoding: functions of the value and the range of its
#: tensor. A codec of one's own is one more entry, with its number in WIRE for the byte count.
ROUNDTRIPS = {"none": lambda v, low, high: v, "fp16": lambda v, low, high: fp16_roundtrip(v), "int8": int8_roundtrip}
WIRE = {"none": DENSE, "fp16": FP16, "int8": INT8, "topk": SPARSE}
