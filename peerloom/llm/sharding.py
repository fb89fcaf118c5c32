"""Operator 3: proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked. Row r (from 1)
of a source with n rows gets the fractional rank (2r - 1) / 2n. Sorting all
rows by it interleaves the sources in proportion; cutting the order into
equal runs makes every shard match the mixture to within two rows a source.

Edge cases: null source is a stratum of its own; null doc_id sorts first;
null text has size 8 and crc32 0; repeated rows each get a slot (ties broken
by size and crc32, so only indistinguishable rows can swap); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_position

SHARDS = 24
SEED = "interleave-7"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row of ``docs``; shard sizes differ by at most one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("__pl_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ties = ["doc_id", "size", "text_crc32"]
    ranked = with_position(rows, ["source", "__pl_key", *ties]).withColumnRenamed("__pl_pos", "__pl_first")
    strata = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("__pl_n"), F.min("__pl_first").alias("__pl_from"))
    strata = strata.withColumnRenamed("source", "__pl_source")
    frac = (
        ranked.join(strata, F.col("source").eqNullSafe(F.col("__pl_source")))
        .withColumn(
            "__pl_frac",
            (2 * (F.col("__pl_first") - F.col("__pl_from")) + 1).cast("double") / (2 * F.col("__pl_n")).cast("double"),
        )
        .select("doc_id", "source", "size", "text_crc32", "__pl_key", "__pl_frac")
    )
    placed = with_position(frac, ["__pl_frac", "source", "__pl_key", *ties])
    total = rows.agg(F.count(F.lit(1)).alias("__pl_total"))  # one row
    n, k = F.col("__pl_total"), F.lit(shards).cast("long")
    return (
        placed.join(F.broadcast(total))
        .withColumn("shard", F.expr(f"int(__pl_pos * {shards}L div __pl_total)"))
        .withColumn("slot", F.col("__pl_pos") - F.expr(f"(shard * __pl_total + {shards - 1}L) div {shards}L"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )


def op3_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def _crc32_sql(blob: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a blob, by half bytes."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = lambda c, x: f"xor({c} >> 4, list_extract({table}::BIGINT[], (xor({c}, {x}) & 15) + 1))"
    start = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({start}, lambda c, b: {step(step('c', 'b'), '(b >> 4)')}, 4294967295::BIGINT), 4294967295)"


OP3_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        {_crc32_sql("encode(coalesce(text, ''))")} AS text_crc32,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, text_crc32) AS r,
        count(*) OVER (PARTITION BY source) AS n
    FROM sized
), placed AS (
    SELECT *, count(*) OVER () AS total, row_number() OVER (
        ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, k, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos
    FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
    (pos * {SHARDS} // total)::INTEGER AS shard,
    (pos - (pos * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
    NULL::INTEGER AS grown_shard, source
FROM placed"""
