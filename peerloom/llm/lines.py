"""Operator 10: removal of repeated passages by overlapping three-line windows.

Every run of three consecutive lines is hashed. A window whose hash occurs
more than once in the corpus is repeated; its first occurrence (smallest
doc_id, then smallest line number) stays and the lines under every later one
are removed, merged over overlaps. Where a later occurrence overlaps the first
one in the same document, only the lines past the first one go.

Every row is a document of its own, told from others by its doc_id and a hash of
its text: rows that share an id but not the text lose only their own lines.

Edge cases: null text stays null and has no lines; a text of fewer than three
lines has no window and is kept; blank windows (all three lines empty) count
like any other; a null doc_id sorts first; rows that are equal in id and text cannot
be told apart and count as one document (all of them lose the same lines); an empty
table gives no rows; extra columns pass through untouched, but ``n_lines`` and
``n_removed`` are the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _hash():
    return F.xxhash64("text")


def _windows(docs: DataFrame, size: int) -> DataFrame:
    lines = docs.select("doc_id", _hash().alias("th"), F.split("text", "\n", -1).alias("ls")).where(F.size("ls") >= size)
    at = F.sequence(F.lit(0), F.size("ls") - size)
    hashed = lines.select(
        "doc_id",
        "th",
        F.posexplode(
            F.transform(
                at,
                lambda i: F.struct(
                    F.xxhash64(*[F.get("ls", i + k) for k in range(size)]).alias("h1"),
                    F.hash(F.lit(977), *[F.get("ls", i + k) for k in range(size)]).alias("h2"),
                ),
            )
        ).alias("pos", "h"),
    )
    return hashed.select("doc_id", "th", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), spans: array of (start, stop) line ranges, as found, of later occurrences."""
    w = _windows(docs, size)
    first = (
        w.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("f"))
        .where("n > 1")
        .select("h1", "h2", "f")
    )
    later = w.join(first, ["h1", "h2"]).where(
        "not (doc_id <=> f.doc_id and th = f.th and pos = f.pos)"
    )
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))
    start = F.when(same, F.greatest("pos", F.col("f.pos") + size)).otherwise(F.col("pos"))
    return (
        later.select("doc_id", "th", start.alias("start"), (F.col("pos") + size).alias("stop"))
        .where("start < stop")
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, plus ``n_lines`` and ``n_removed``."""
    spans = repeated_spans(docs, size).withColumnsRenamed({"doc_id": "__pl_id", "th": "__pl_th", "spans": "__pl_spans"})
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__pl_id")) & (_hash() == F.col("__pl_th")), "left")

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def clean(text, starts, stops):
        import numpy as np
        import pandas as pd

        out = []
        for t, a, z in zip(text, starts, stops):
            if t is None:
                out.append((None, 0, 0))
                continue
            ls = t.split("\n")
            if a is None or not len(a):
                out.append((t, len(ls), 0))
                continue
            edge = np.zeros(len(ls) + 1, dtype=np.int64)
            np.add.at(edge, np.minimum(a, len(ls)), 1)
            np.add.at(edge, np.minimum(z, len(ls)), -1)
            kept = [x for x, c in zip(ls, np.cumsum(edge)) if c == 0]
            out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    return (
        joined.withColumn("__pl_c", clean("text", F.col("__pl_spans.start"), F.col("__pl_spans.stop")))
        .withColumn("text", F.col("__pl_c.text"))
        .withColumn("n_lines", F.col("__pl_c.n_lines"))
        .withColumn("n_removed", F.col("__pl_c.n_removed"))
        .drop("__pl_c", "__pl_id", "__pl_th", "__pl_spans")
    )


def op10_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("digest"))


OP10_SQL = """
with l as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
w as (select doc_id, unnest(range(0, len(ls) - 2)) pos, ls from l where len(ls) >= 3),
k as (select doc_id, pos, ls[pos + 1] a, ls[pos + 2] b, ls[pos + 3] c from w),
f as (select a, b, c, count(*) n, min({'d': doc_id, 'p': pos}) f from k group by a, b, c having count(*) > 1),
s as (select k.doc_id, case when k.doc_id = f.f.d then greatest(k.pos, f.f.p + 3) else k.pos end s, k.pos + 3 e
      from k join f using (a, b, c) where not (k.doc_id = f.f.d and k.pos = f.f.p)),
r as (select distinct doc_id, unnest(range(s, e)) i from s where s < e),
x as (select doc_id, unnest(range(0, len(ls))) i, ls from l),
y as (select x.doc_id, x.i, x.ls[x.i + 1] line, r.i is not null gone
      from x left join r on x.doc_id = r.doc_id and x.i = r.i)
select doc_id, cast(count(*) as integer) n_lines, cast(count(*) filter (where gone) as integer) n_removed,
       md5(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) digest
from y group by doc_id
union all select doc_id, 0, 0, null from documents where text is null
"""
