"""The pipeline against a plain version of every stage, run one after the other."""

import hashlib
import math
import zlib
from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from peerloom.llm import decontam, mixture, ordinal, sharding, simhash
from test_operators import EDGES, SF, edge_docs, plain_copies


def plain_near(rows):
    """One row of each group of texts of cosine 0.8 or more; rows are (doc_id, text, ...)."""
    from xxhash import xxh64_intdigest

    signed = lambda x: x - 2**64 if x >> 63 else x
    sets = []
    for r in rows:
        ws = (r[1] or "").encode().lower().split()
        sets.append(frozenset(b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
            if same or (a and b and len(a & b) >= 0.8 * math.sqrt(len(a) * len(b)) - 1e-9):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, signed(xxh64_intdigest((r[1] or "").encode(), 42)))
        c = find(i)
        best[c] = min(best.get(c, (key, i)), (key, i))
    return [rows[i] for _, i in sorted(best.values())]


def plain_shards(rows, shards=24):
    """(doc_id, size, crc, shard, slot) of (doc_id, text, lang, source) rows."""
    info = [
        (s is not None, s or "", hashlib.md5(f"{sharding.SEED}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0,
         len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        for i, t, _, s in rows
    ]
    total, ranked, by = Counter(x[:2] for x in info), [], Counter()
    for x in sorted(info):
        ranked.append(((2 * by[x[:2]] + 1) / (2 * total[x[:2]]), x))
        by[x[:2]] += 1
    out, n, slots = [], len(info), Counter()
    for pos, (_, x) in enumerate(sorted(ranked)):
        shard = pos * shards // n
        out.append((x[4] if x[3] else None, x[5], x[6], shard, slots[shard]))
        slots[shard] += 1
    return out


def test_run_equals_plain_stages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = ordinal.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)  # tested against the likelihood on its own
    rows = [r for r in docs if model.score(r[1])[1][-1] >= 0.5]
    assert 0 < len(rows) < len(docs)
    rows = plain_near(rows)
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    index = decontam.Index(decontam.make_parts(list(zip(bench["item_id"], bench["text"]))))  # tested against all parts on its own
    rows = [r for r, got in zip(rows, decontam._search([r[1] for r in rows], index, decontam.THRESHOLD)) if not got]
    domain = {r["source"]: r["domain"] for r in mixture.with_domain(spark.createDataFrame([(s,) for s in {r[3] for r in rows}], "source string")).collect()}
    leaves = [(i, t, (domain[s], lang, s)) for i, t, lang, s in rows]
    copies = plain_copies(leaves, mixture.WEIGHTS, mixture.BUDGET_SHARE, mixture.MAX_EPOCHS, mixture.SEED)
    mixed = [r for r, leaf in zip(rows, leaves) for _ in range(copies[leaf][0])]
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect())
    want = sorted(plain_shards(mixed))
    if got != want:  # a leaf's budget may round otherwise by a token; no more than a few rows may differ then
        a, b = Counter(x[0] for x in got), Counter(x[0] for x in want)
        assert sum(((a - b) + (b - a)).values()) <= 3 and plain_shards([r for r in rows for _ in range(a[r[0]])]) != []
        again = sorted(plain_shards([r for r in rows for _ in range(a[r[0]])]))
        assert got == again


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null and empty and very long texts, ties, clashing names: columns stay, every stage is plain."""
    long = "the quick brown fox and others " * 400
    rows = [*EDGES, (20, long), (21, long + "more"), (None, long), (20, "other words under the same id"), (None, None)]
    docs = edge_docs(spark, rows)
    out = corpus_pipeline.near_dups(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:30]) for r in out.collect()) == sorted((i or -1, (t or "")[:30]) for i, t, *_ in plain_near(rows))
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.decontaminate(spark, docs, SF).count() == len(rows)
    placed = corpus_pipeline.shard(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in placed) == sorted((x[0] or -1, x[3], x[4]) for x in plain_shards([(i, t, None, None) for i, t in rows]))
    assert corpus_pipeline.near_dups(spark, docs.limit(0), SF).count() == 0 and corpus_pipeline.shard(spark, docs.limit(0), SF).count() == 0
    assert simhash.SIMILARITY == 0.8 and simhash.SHINGLE == 5
