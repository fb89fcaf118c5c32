"""Operator 8: benchmark decontamination with a BM25 index and block-max WAND.

Test items are cut into overlapping parts of at most 64 words, so that every
run of 96 words holds a whole part, and indexed with BM25 impacts, each divided
by the part's own score, so that a score is the share of the part that a passage
covers. Documents are cut into passages of 128 words, 64 apart, so that each run
of up to 65 words lies whole in one passage. Every passage is a query, and all
parts at or above the threshold are retrieved:

A term's posting list is sorted by part and cut into blocks of parts, each with its
greatest impact. The terms of a passage are ordered by their lists' greatest impacts;
those whose impacts together stay below the threshold cannot bring a part in alone,
so only the lists of the others are read (the pivots of WAND, for a fixed threshold).
Their block maxima, and then those of the skipped lists, which are only probed at
these blocks, bound each block; the parts of a block are scored only if its bound
reaches the threshold. All passages of a text go through these steps at once.

A hit counts only if the text holds the part's question and answer, or all of the
part but a few edits. Words are case-folded runs of letters and digits, and single
characters in scripts that put no spaces between words, so case and punctuation do
not hide a copy. Verification takes shingles of five words: 0.8 of the
question's and 0.8 of the answer's must be in the passage. The answer is the
last sentence of a part, or its last quarter where it has one sentence. Else the
part must align with a run of words by edits (words put in, left out or
replaced) of at most a fifth of its words; both shares are then one less the
edits over its words. Parts of under five words must be held as they stand.

Statistics are those of all parts. A benchmark of over SLICE_BYTES of text is indexed in
slices, each small enough to be broadcast, and the documents are scanned once for each.

Edge cases: null or empty texts give no passage and no hit; items without
words are never found; rows that repeat a doc_id are documents of their own;
null doc_ids can be hit; items with equal ids and texts are one item, those with equal
ids and other texts are found under that id; empty tables give no rows;
``drop_contaminated`` keeps extra columns and all rows without a hit.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP, SHINGLE = 0.8, 5
PASSAGE, STRIDE = 128, 64
#: Parts of a block, and bytes of items in an index that is broadcast.
BLOCK, SLICE_BYTES = 8, 16 << 20
FIND = re.compile(r"[^\W_]+").findall
#: Scripts without spaces between words: Thai to Tibetan, Khmer, kana, Han.
BARE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HAS_BARE = re.compile(f"[{BARE}]").search
SPLIT = re.compile(f"[{BARE}]|[^\\W_{BARE}]+").findall


def words_of(text) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return SPLIT(low) if not low.isascii() and HAS_BARE(low) else FIND(low)


def _cut(ws: list[str]) -> list[tuple[int, int]]:
    """Parts of STRIDE words (a shorter text is one part), half a part or less apart."""
    last = max(0, len(ws) - STRIDE)
    starts = [*range(0, last, STRIDE // 2), last]
    return [(a, min(a + STRIDE, len(ws))) for a in starts]


def _edits(part: list[str], text: list[str]) -> int:
    """Fewest words put in, left out or replaced that turn ``part`` into a run of ``text``."""
    import numpy as np

    code = {w: i for i, w in enumerate(part)}
    t = np.array([code.get(w, -1) for w in text], dtype=np.int64)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for w in part:
        new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (t != code[w]))])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def _shingles(ws: list[str]) -> set:
    return {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


def _stats(parts: list[tuple]) -> tuple[dict[str, int], int, float]:
    """Document frequencies of the words, number and mean length of the parts."""
    df: dict[str, int] = {}
    for _, ws, *_ in parts:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    return df, len(parts), sum(len(p[1]) for p in parts) / max(1, len(parts))


class Index:
    """Posting lists of item parts, sorted by part, with the greatest impact of each block; all in flat arrays.

    ``stats`` as from ``_stats`` for all parts, where ``parts`` are some of them.
    """

    def __init__(self, parts: list[tuple], stats: tuple | None = None):
        import numpy as np

        self.parts = parts  # (item_id, words, question shingles, answer shingles)
        df, total, mean = stats or _stats(parts)
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p[1]))}
        term, part, impact = [], [], []
        for d, (_, ws, *_) in enumerate(parts):
            tf: dict[str, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            raw = [
                math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean))
                for w, c in tf.items()
            ]
            own = sum(raw)
            term += [self.ids[w] for w in tf]
            part += [d] * len(tf)
            impact += [x / own for x in raw]
        term, part, impact = np.array(term, dtype=np.int64), np.array(part, dtype=np.int64), np.array(impact)
        order = np.lexsort((part, term))
        self.part, self.impact = part[order], impact[order]
        self.blocks = -(-len(parts) // BLOCK)
        #: A block of a list is known by term * blocks + block; ``first`` is its first posting.
        code = term[order] * max(1, self.blocks) + self.part // BLOCK
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.list = np.searchsorted(self.code, np.arange(len(self.ids) + 1) * max(1, self.blocks))
        self.top = np.maximum.reduceat(self.block_max, self.list[:-1]) if len(self.ids) else np.zeros(0)

    def wand(self, win, term, threshold: float):
        """(passage, part, score) of all with a score of ``threshold`` or more. ``win``, ``term``: the distinct terms of each
        passage, sorted by passage."""
        import numpy as np

        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(win):
            return none
        # The terms of a passage by the greatest impacts of their lists: those whose sum stays below are skipped.
        order = np.lexsort((self.top[term], win))
        win, term = win[order], term[order]
        top = self.top[term]
        head = np.flatnonzero(np.diff(win, prepend=-1))
        size = np.diff(np.append(head, len(win)))
        run = np.cumsum(top)
        upto = run - np.repeat(run[head] - top[head], size)
        pivot = upto >= threshold - 1e-9
        skipped = np.bincount(win[~pivot], weights=top[~pivot], minlength=int(win[-1]) + 1)
        pw, pt = win[pivot], term[pivot]
        at, owner = _expand(self.list[pt], self.list[pt + 1])
        key = pw[owner] * self.blocks + self.code[at] % self.blocks
        keys, where = np.unique(key, return_inverse=True)
        bound = np.bincount(where, weights=self.block_max[at], minlength=len(keys))
        live = bound + skipped[keys // max(1, self.blocks)] >= threshold - 1e-9
        if not live.any():
            return none
        # The skipped lists are probed at the live blocks.
        keys, bound = keys[live], bound[live]
        last = np.searchsorted(win, np.arange(int(win[-1]) + 2))
        here, owner = _expand(last[keys // self.blocks], last[keys // self.blocks + 1])
        code = term[here] * self.blocks + keys[owner] % self.blocks
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        hit = self.code[at] == code
        at, owner = at[hit], owner[hit]
        full = np.bincount(owner, weights=self.block_max[at], minlength=len(keys)) >= threshold - 1e-9
        at, owner = at[full[owner]], owner[full[owner]]
        post, which = _expand(self.first[at], self.first[at + 1])
        pair = (keys[owner] // self.blocks)[which] * len(self.parts) + self.part[post]
        pairs, where = np.unique(pair, return_inverse=True)
        score = np.bincount(where, weights=self.impact[post], minlength=len(pairs))
        good = score >= threshold - 1e-9
        return pairs[good] // len(self.parts), pairs[good] % len(self.parts), score[good]


def _expand(start, stop):
    """All numbers from each start up to its stop, and which range each is of."""
    import numpy as np

    size = stop - start
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def make_parts(items: list[tuple]) -> list[tuple]:
    out = []
    for item_id, text in items:
        sentences = [ws for ws in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text or "")) if ws]
        flat = [w for ws in sentences for w in ws]
        tail = len(sentences[-1]) if len(sentences) > 1 else 0
        for a, b in _cut(flat) if flat else []:
            ws = flat[a:b]
            k = len(ws) - min(tail, len(ws) // 2) if b == len(flat) and tail else len(ws) - max(1, len(ws) // 4)
            out.append((item_id, ws, _shingles(ws[: max(k, 1)]), _shingles(ws[k:] or ws)))
    return out


def _search(texts: list, index: Index, threshold: float, most: int = 1 << 15):
    """For each text, {part: (score, question overlap, answer overlap)} of the verified hits. The passages of texts of
    about ``most`` known words in all are queried together."""
    import numpy as np

    get = index.ids.get
    found: list[dict] = [{} for _ in texts]
    asked, wins, terms, base, size = [], [], [], 0, 0
    for k, text in enumerate(texts):
        ws = words_of(text)
        ids = np.array([get(w, -1) for w in ws], dtype=np.int64)
        at = np.flatnonzero(ids >= 0)
        if len(at):
            last = max(0, -(-(len(ws) - PASSAGE) // STRIDE))
            # A word lies in the passage that starts in its own stride and in the one before.
            chunk = at // STRIDE
            wins += [np.minimum(chunk, last) + base, np.clip(chunk - 1, 0, last) + base]
            terms += [ids[at]] * 2
            asked.append((k, ws, base))
            base, size = base + last + 1, size + len(at)
        if asked and (size >= most or k == len(texts) - 1):
            pair = np.unique(np.concatenate(wins) * len(index.ids) + np.concatenate(terms))
            first = [x[2] for x in asked]
            win, part, score = index.wand(pair // len(index.ids), pair % len(index.ids), threshold)
            of = np.searchsorted(first, win, "right") - 1
            have, shown = set(), -1
            for w, d, x, i in zip(win.tolist(), part.tolist(), score.tolist(), of.tolist()):
                k_, ws_, base_ = asked[i]
                if w != shown:
                    have, shown = _shingles(ws_[(w - base_) * STRIDE : (w - base_) * STRIDE + PASSAGE]), w
                _verify(found[k_], index, d, x, ws_, w - base_, have)
            asked, wins, terms, base, size = [], [], [], 0, 0
    return found


def _verify(hits: dict, index: Index, d: int, score: float, ws: list[str], w: int, have: set) -> None:
    """Put part ``d`` among the hits if passage ``w`` of the words holds its question and answer, or all of it but a few edits."""
    _, part, q, a = index.parts[d]
    if len(part) < SHINGLE:
        text_of = " " + " ".join(ws[w * STRIDE : w * STRIDE + PASSAGE]) + " "
        qo = ao = float(" " + " ".join(part) + " " in text_of)
    else:
        qo, ao = _held(q, have, ws, w), _held(a, have, ws, w)
    if (qo < OVERLAP or ao < OVERLAP) and len(part) >= SHINGLE:
        # An edited copy may reach over the passage's ends by the words that were put in.
        room = ws[max(0, w * STRIDE - STRIDE // 4) : w * STRIDE + PASSAGE + STRIDE // 4]
        wrong = _edits(part, room)
        if (len(part) - wrong) / len(part) >= OVERLAP:
            qo = ao = (len(part) - wrong) / len(part)
    if qo >= OVERLAP and ao >= OVERLAP and (d not in hits or score > hits[d][0]):
        hits[d] = (score, qo, ao)


def _held(need: set, have: set, ws: list[str], w: int) -> float:
    short = [s for s in need if len(s) < SHINGLE]
    n = len(need & have)
    if short:  # an answer of fewer words than a shingle is looked up as it stands
        text = " " + " ".join(ws[w * STRIDE : w * STRIDE + PASSAGE]) + " "
        n += sum(s not in have and " " + " ".join(s) + " " in text for s in short)
    return n / max(1, len(need))


def _indexes(bench: DataFrame, slice_bytes: int) -> list:
    """Broadcast indexes of slices of the items, each of about ``slice_bytes`` of text, with the statistics of all parts.

    The driver holds the items of one slice at a time. Frequencies of the words of all slices are counted by Spark.
    """
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    slices = max(1, -(-size // slice_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    sc = bench.sparkSession.sparkContext
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    if slices == 1:
        parts = make_parts(sorted(map(tuple, items.collect()), key=order))
        return [sc.broadcast(Index(parts, _stats(parts)))] if parts else []

    def words(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (w, k, len(part) if i == 0 else 0)
                for item, text, k in zip(pdf["item_id"], pdf["text"], pdf["slice"]) for _, part, *_ in make_parts([(item, text)]) for i, w in enumerate(set(part))
            ]
            yield pd.DataFrame(rows, columns=["word", "slice", "size"])

    # A row for each word of each part; the first one of a part carries its length.
    each = durable(items.withColumn("slice", number).mapInPandas(words, "word string, slice long, size long"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("slice").alias("slices"))
    head = each.agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("words")).first()
    df, out = durable(df), []
    for k in range(slices):
        parts = make_parts(sorted(map(tuple, items.where(number == k).collect()), key=order))
        if parts:
            known = {r["word"]: r["df"] for r in df.where(F.array_contains("slices", k)).select("word", "df").collect()}
            out.append(sc.broadcast(Index(parts, (known, head["n"], head["words"] / max(1, head["n"])))))
    return out


def hits(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each document row and item found."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(shared):
        def run(batches):
            import pyarrow as pa

            index = shared.value
            for b in batches:
                out = []
                for i, got in zip(b.column(0).to_pylist(), _search(b.column(1).to_pylist(), index, threshold)):
                    own: dict = {}
                    for d, v in got.items():
                        item = index.parts[d][0]
                        own[item] = max(own.get(item, v), v)
                    out += [(i, item, *v) for item, v in own.items()]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        return run

    found = [rows.mapInArrow(scan(shared), schema) for shared in _indexes(bench, slice_bytes)]
    if not found:
        return rows.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])])
    # An item lies whole in one slice.
    return functools.reduce(DataFrame.unionAll, found)


def drop_contaminated(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without the rows in which an item is found; decided row by row, without a shuffle."""

    def dirty(shared):
        @F.pandas_udf(T.BooleanType())
        def look(texts):
            import pandas as pd

            return pd.Series([bool(got) for got in _search(list(texts), shared.value, threshold)], dtype=bool)

        return look

    for shared in _indexes(bench, slice_bytes):
        docs = docs.where(~dirty(shared)(F.col("text").cast("string")))
    return docs


def op8_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
