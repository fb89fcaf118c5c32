"""Operator 4: SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 16 four-bit segments are mapped to their bit counts. The
Manhattan distance of two count vectors never exceeds the Hamming distance of
the fingerprints, so a grid range-join over the vectors finds every pair
within the radius: both sides register at their own cell and at the 32 cells
one step away, hence two vectors at distance 2 meet at the cell between them.
The join verifies the Hamming distance exactly. Only distinct fingerprints
are joined, so groups of exact copies never pair up.

``dedup`` is the pipeline's stage: its links are texts whose sets of five-word
shingles have a cosine similarity of 0.8 or more, the similarity that SimHash
stands for. Two such texts differ by 13 of 64 bits on average, and a grid of
16 dimensions would need the cells within half of that distance around every
point (over a million), so whole fingerprints are joined within RADIUS only. The
other candidates are *views*: SimHashes of the SAMPLE shingles that come first
in a seeded order, one of which must be equal. All links are verified exactly.

Edge cases: null text is an empty text; a text without words has fingerprint
zero; fewer words than a shingle form one shingle; every row is a document of
its own, whatever its id: rows with a null doc_id are linked like others and name no
component, so that one without linked ids has a null component; an empty table gives
no rows; extra columns are ignored (``link``) or kept (``dedup``). In ``dedup`` texts
without words are equal and one of them stays; of rows that are equal in id and text
one stays; of each group the row with the smallest doc_id stays, a null one last, and
of several with that id the one with the smallest hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, durable, tokens_of

RADIUS = 2
#: Two texts of equal length and cosine 0.8 share 2/3 of their shingles in union, and
#: miss all VIEWS with probability (1 - (2/3)^4)^24 = 0.005 (of unequal length: less than 0.02).
VIEWS, SAMPLE, SIMILARITY, SHINGLE = 24, 4, 0.8, 5
#: Most shingles of a text that gets keys of its subsets; views miss short texts more often.
SHORT = 10
#: Documents of one candidate group that one task compares at a time, and those that all blocks are compared with.
BLOCK, HUBS = 2500, 8


def shingle_hashes(words: list[bytes], n: int):
    """XXH64 (seed 42) of every n-word shingle, repeats included, as uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    view = memoryview(joined)
    return np.array([xxh64_intdigest(view[s:e], 42) for s, e in zip(starts, stops[n - 1 :])], dtype=np.uint64)


def simhash(h) -> int:
    """Bit is 1 if set in over half of the hashes; unsigned 64-bit."""
    import numpy as np

    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), 200):
        ones += np.unpackbits(raw[i : i + 200], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _views(h, views: int, sample: int) -> list[int]:
    import numpy as np

    distinct, out = np.unique(h), []
    for v in range(views):
        mixed = (distinct ^ np.uint64((v + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        take = np.argpartition(mixed, sample - 1)[:sample] if len(mixed) > sample else slice(None)
        some = distinct[take].tolist()
        if len(some) == 4:  # a bit that is set in over half of four is set in three of them
            a, b, c, d = some
            out.append((a & b & (c | d)) | (c & d & (a | b)))
        else:
            out.append(simhash(distinct[take]))
    return out


def _deletions(h, similarity: float):
    """Keys of a set of at most SHORT shingle hashes: hashes of the set less each choice of few enough elements.

    Two sets of cosine s share at least s * sqrt(their sizes) elements, and the larger has at most 1/s^2 times the
    smaller's, so that at most 1 - s^2 of either are not in the other; less these, both are the same set. Thus no such
    pair of small sets is without an equal key.
    """
    import itertools

    import numpy as np
    from xxhash import xxh64_intdigest

    own = np.unique(h)
    n = len(own)
    if not 0 < n <= SHORT:
        return []
    most = int((1 - similarity**2) * n + 1e-9)
    left = [np.delete(own, gone) for k in range(most + 1) for gone in map(list, itertools.combinations(range(n), k))]
    return [xxh64_intdigest(x.tobytes(), 43) for x in left]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int, views: int = 0, sample: int = SAMPLE, similarity: float = 1.0) -> DataFrame:
    """doc_id, th (hash of the text), fp (the 64 bits as a long), fps (those of the views), words (128-bit hash of the
    word sequence), and cuts (keys of a short text's subsets, if ``similarity`` is below 1)."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            fp, vs, seq, cuts = [], [], [], []
            for t in b.column(1).to_pylist():
                words = tokens_of(t)
                h = shingle_hashes(words, shingle)
                fp.append(_signed(simhash(h)))
                vs.append([_signed(x) for x in _views(h, views, sample)])
                seq.append(xxh3_128_digest(b" ".join(words)))
                cuts.append([_signed(x) for x in _deletions(h, similarity)] if similarity < 1 else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(fp, pa.int64()), pa.array(vs, pa.list_(pa.int64())), pa.array(seq, pa.binary()),
                 pa.array(cuts, pa.list_(pa.int64()))],
                names=["doc_id", "th", "fp", "fps", "words", "cuts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _hash().alias("th")).mapInArrow(
        run, "doc_id long, th long, fp long, fps array<long>, words binary, cuts array<long>"
    )


def _hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _cell(fp: str):
    """The 16 segment counts, each plus one so that a neighbour below zero stays in its four bits."""
    low = 0xFFFFFFFF

    def pairs(half):
        return half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))

    # By halves of 32 bits, so that no sum reaches the sign bit.
    lo, hi = pairs(F.col(fp).bitwiseAND(F.lit(low))), pairs(F.shiftrightunsigned(fp, 32))
    three = F.lit(0x33333333)

    def nibbles(x):
        return x.bitwiseAND(three) + F.shiftrightunsigned(x, 2).bitwiseAND(three)

    return F.shiftleft(nibbles(hi), 32).bitwiseOR(nibbles(lo)) + F.lit(0x1111111111111111)


def range_join(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct long ``fp`` values (signed order) that differ in 1 to ``radius`` bits.

    Spark takes an exploded table for no larger than what it was exploded from, and would broadcast 33 rows
    for each point through the driver; the merge join keeps them on the executors.
    """
    if not 0 < radius <= 2:
        raise ValueError("the grid registers points one step around their cell: radius 1 or 2")
    cell = points.select("fp", _cell("fp").alias("c"))
    steps = [F.col("c")] + [F.col("c") + F.lit(s << (4 * i)) for i in range(16) for s in (1, -1)]
    grid = cell.select("fp", F.explode(F.array(*steps)).alias("cell"))
    a, b = grid.alias("x"), grid.alias("y").hint("merge")
    return (
        a.join(b, F.expr(f"x.cell = y.cell and x.fp < y.fp and bit_count(x.fp ^ y.fp) <= {radius}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .distinct()
    )


def link(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id of those whose fingerprints are linked within ``radius`` bits."""
    rows = durable(fingerprints(docs, shingle).select("doc_id", "fp"))
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(range_join(reps.select("fp"), radius))
    named = durable(reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c")))
    ids = named.groupBy("c").agg(F.min("rep").alias("cid"))
    return rows.join(named.join(ids, "c").select("fp", "cid"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("cid").alias("component_id")
    )


def op4_query(spark, sf_dir) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _forest(rows: DataFrame, keys: list[str], similarity: float, shingle: int) -> DataFrame:
    """nb, a, b: in each group of ``keys``, a spanning forest of the links that join different labels.

    ``rows`` has nb, doc_id, text, label and lead; a pair is compared if one of its documents leads.
    """

    def forest(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.drop_duplicates("doc_id").sort_values(["lead", "doc_id"], ascending=[False, True])
        ids, labels = pdf["doc_id"].to_numpy(), pdf["label"].to_numpy()
        sets = [np.unique(shingle_hashes(tokens_of(t), shingle)) for t in pdf["text"]]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        flat, code = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        mark = np.zeros(len(flat), dtype=bool)
        out = []
        for x in range(int(pdf["lead"].sum())):
            if not size[x]:
                continue
            own = code[start[x] : start[x + 1]]
            mark[own] = True
            both = np.bincount(owner[start[x + 1] :][mark[code[start[x + 1] :]]], minlength=len(ids))
            mark[own] = False
            near = np.flatnonzero((both > 0) & (both >= similarity * np.sqrt(size[x] * size) - 1e-9))
            for y in near.tolist():
                p, q = find(labels[x]), find(labels[y])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((pdf["nb"].iat[0], ids[x], ids[y]))
        return pd.DataFrame(out, columns=["nb", "a", "b"]).astype("int64")

    return rows.groupBy(*keys).applyInPandas(forest, "nb long, a long, b long")


def _verified_links(docs: DataFrame, groups: DataFrame, similarity: float, shingle: int, block: int, hubs: int) -> DataFrame:
    """a, b: links with the components of all pairs of a group (gid, doc_id) whose sets of shingle hashes
    have a cosine of ``similarity`` or more.

    A group is dealt into blocks of about ``block`` documents by a hash of the id, and each
    block is compared within itself and with ``hubs`` documents of its group. Near copies of
    the hubs are then one class; only documents outside their group's largest class are compared
    again, with all blocks but their own. Thus a group of near copies takes work in
    proportion to its size, and every task holds two blocks at most.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    number = F.xxhash64("doc_id")
    sizes = groups.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("nb"))
    dealt = durable(groups.join(sizes, "gid").select("gid", "doc_id", "nb", F.pmod(number, F.col("nb")).alias("i")))
    large = dealt.where("nb > 1")
    first = F.row_number().over(Window.partitionBy("gid").orderBy(number, "doc_id"))
    hub = large.withColumn("r", first).where(F.col("r") <= hubs)
    hub = hub.select("gid", "doc_id", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("i"))
    rows = dealt.union(hub).withColumn("label", F.col("doc_id")).withColumn("lead", F.lit(True))
    links = durable(_forest(rows.join(texts, "doc_id"), ["gid", "i"], similarity, shingle))
    if not large.limit(1).count():
        return links.select("a", "b")
    classes = components(links.where("nb > 1"))
    label = F.coalesce("component", "doc_id").alias("label")
    large = durable(large.join(classes, large["doc_id"] == classes["node"], "left").select("gid", "doc_id", "nb", label))
    top = (
        large.groupBy("gid", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("gid")
        .agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_all"))
        .where("n_all > n_top")
        .select("gid", "top", F.ceil((F.col("n_all") - F.col("n_top")) / F.lit(block)).alias("nu"),
                F.ceil(F.col("n_top") / F.lit(block)).alias("nt"))
    )
    # Blocks 0 to nu-1 hold the documents outside the largest class, the others those in it.
    lead = F.col("label") != F.col("top")
    others = F.sequence(F.lit(0).cast("long"), F.col("nu") - 1 + F.when(F.col("lead"), F.col("nt")).otherwise(0))
    own = F.when(F.col("lead"), F.pmod(number, F.col("nu"))).otherwise(F.col("nu") + F.pmod(number, F.col("nt")))
    rest = (
        large.join(top, "gid")
        .withColumn("lead", lead)
        .select("gid", "doc_id", "nb", "label", "lead", own.alias("own"), F.explode(others).alias("other"))
        .select("gid", "doc_id", "nb", "label", "lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    more = durable(_forest(rest.join(texts, "doc_id"), ["gid", "i", "j"], similarity, shingle))
    return links.union(more).select("a", "b")


def _same_key(keys: DataFrame) -> DataFrame:
    """a, b: each ``no`` and the smallest with an equal key (v, h), as stars.

    ``keys`` are exploded, up to 200 rows for a text, and thus larger than Spark takes them for: never a broadcast.
    """
    star = keys.groupBy("v", "h").agg(F.min("no").alias("b"), F.max("no").alias("m")).where("b < m")
    return keys.join(star.hint("merge"), ["v", "h"]).select(F.col("no").alias("a"), "b")


def near_groups(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    views: int = VIEWS,
    sample: int = SAMPLE,
    block: int = BLOCK,
    hubs: int = HUBS,
) -> DataFrame:
    """doc_id, th (hash of the text), component_id (the smallest doc_id linked), stays: one row for each row of ``docs``.

    Texts with equal word sequences are one node. Candidates: whole-text fingerprints within ``radius`` (the
    grid range-join), equal fingerprints of a view, and for texts of at most SHORT shingles
    equal subsets, which lose no link between two such texts. All are joined into candidate groups by
    stars, never by all pairs; the links inside a group are then verified exactly.
    """
    rows = durable(fingerprints(docs, shingle, views, sample, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    # Numbered once, in a checkpoint, so that a retry gives the same numbers.
    texts = durable(
        rows.groupBy("words").agg(first, *[F.first(c).alias(c) for c in ("fp", "fps", "cuts")]).withColumn("no", F.monotonically_increasing_id())
    )
    keys = texts.select("no", F.posexplode("fps").alias("v", "h")).union(
        texts.select("no", F.lit(-1), F.col("fp"))
    ).union(texts.select("no", F.lit(-2), F.explode("cuts")))
    same = _same_key(keys)
    by_fp = texts.groupBy("fp").agg(F.min("no").alias("no"))
    pairs = range_join(by_fp.select("fp"), radius)
    close = (
        pairs.join(by_fp.select(F.col("fp").alias("a"), F.col("no").alias("ra")), "a")
        .join(by_fp.select(F.col("fp").alias("b"), F.col("no").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    groups = durable(components(same.union(close)).select(F.col("node").alias("doc_id"), F.col("component").alias("gid")))
    wanted = texts.join(groups, F.col("no") == groups["doc_id"], "left_semi").select("no", F.col("first.doc_id").alias("__pl_id"), F.col("first.th").alias("__pl_th"))
    bodies = docs.select(F.col("doc_id").cast("long").alias("__pl_doc"), "text", _hash().alias("__pl_h")).join(
        wanted, F.col("__pl_doc").eqNullSafe(F.col("__pl_id")) & (F.col("__pl_h") == F.col("__pl_th"))
    )
    bodies = bodies.select(F.col("no").alias("doc_id"), "text")
    comp = components(_verified_links(bodies, groups, similarity, shingle, block, hubs))
    named = durable(texts.select("words", "no", "first").join(comp, F.col("no") == F.col("node"), "left").select(
        "words", "first", F.coalesce("component", "no").alias("c")
    ))
    best = named.groupBy("c").agg(F.min("first").alias("best"))
    return rows.select("doc_id", "th", "words").join(named.join(best, "c").select("words", "best"), "words").select(
        "doc_id", "th", F.col("best.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))).alias("stays"),
    )


def dedup(docs: DataFrame, **params) -> DataFrame:
    """``docs`` less all rows but one of each near-duplicate group."""
    found = durable(near_groups(docs, **params))
    gone = found.where("not stays").select(F.col("doc_id").alias("__pl_id"), F.col("th").alias("__pl_th"))
    kept = docs.withColumn("__pl_h", _hash()).join(
        gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__pl_id")) & (F.col("__pl_h") == F.col("__pl_th")), "left_anti"
    )
    # Only rows that are equal in id and text are left several times; texts are shuffled for them only if there are any.
    if found.where("stays").groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__pl_h"])
    return kept.drop("__pl_h")
