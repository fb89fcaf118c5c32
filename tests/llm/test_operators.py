"""Each operator against brute force, and its defined results at the edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from compare import assert_same
from peerloom.llm import chroma, decontam, langid, lines, mixture, ordinal, quotes, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, None), (2, ""), (3, "a"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "no id"),
    (7, "word " * 5000), (8, "x" * 50000), (9, "l\nm\nn\nl\nm\nn"), (9, "l\nm\nn\nl\nm\nn"), (10, "é ü\t\n ñ"),
]


def edge_docs(spark, rows=EDGES):
    """Odd rows, with every other column null and extra columns whose names could clash."""
    full = [(i, t, None, None, None, 1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, word long, fp string")


def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.SQL[name])


def plain_plan(leaves, budget, weights, levels, epochs, path=()):
    """Tokens of each leaf, by handing out the budget of a node again and again until it or its children are used up."""
    if len(path) == len(levels):
        return {path: budget}
    weight = lambda name, k: weights[levels[k]].get(name, weights[levels[k]].get("*", 0))
    names = sorted({p[len(path)] for p in leaves if p[: len(path)] == path})
    cap = {
        n: sum(t * epochs for p, t in leaves.items() if p[: len(path) + 1] == (*path, n) and all(weight(p[k], k) > 0 for k in range(len(levels))))
        for n in names
    }
    given, live = dict.fromkeys(names, 0.0), [n for n in names if weight(n, len(path)) > 0 and cap[n] > 0]
    left = min(budget, sum(cap[n] for n in live))
    while left > 1e-6 and live:
        total, more = sum(weight(n, len(path)) for n in live), 0.0
        for n in live:
            part = min(left * weight(n, len(path)) / total, cap[n] - given[n])
            given[n] += part
            more += part
        left -= more
        live = [n for n in live if cap[n] - given[n] > 1e-6]
    out = {}
    for n in names:
        out |= plain_plan(leaves, given[n], weights, levels, epochs, (*path, n))
    return out


def planned(spark, leaves, budget, weights, epochs):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "a string, b string, c string, tokens long")
    return {(r["a"], r["b"], r["c"]): r["budget"] for r in mixture.plan_budget(df, budget, weights, names, mixture.LEVELS, epochs).collect()}


def test_budget_shares(spark):
    assert mixture.share_out(100, [("a", 1, 10), ("b", 1, 200), ("c", 2, 200)]) == {"a": 10, "b": 30, "c": 60}
    leaves = {("d", "en", "s"): 100, ("d", "fr", "s"): 10, ("e", "en", "s"): 1000}
    w = {"domain": {"*": 1}, "lang": {"*": 1}, "source": {"*": 1}}
    plan = planned(spark, leaves, 200, w, 1)
    assert plan == {("d", "en", "s"): 90, ("d", "fr", "s"): 10, ("e", "en", "s"): 100}  # the sibling takes what fr lacks
    assert sum(planned(spark, leaves, 900, w, 1).values()) == 900
    # A child of weight zero has nothing to give: its parent's share goes to the parent's siblings.
    leaves = {("d0", "xx", "s"): 1000, ("d0", "en", "s"): 100, ("d1", "en", "s"): 2500}
    w = {"domain": {"*": 1}, "lang": {"xx": 0, "*": 1}, "source": {"*": 1}}
    assert planned(spark, leaves, 1000, w, 1) == {("d0", "xx", "s"): 0, ("d0", "en", "s"): 100, ("d1", "en", "s"): 900}


def test_budget_is_given_whole(spark):
    """The sum given is the budget or all that is usable; each leaf gets what a plain water-filling gives it."""
    rand = np.random.default_rng(21)
    for _ in range(4):
        leaves = {
            (f"d{rand.integers(3)}", f"l{rand.integers(3)}", f"s{rand.integers(4)}"): int(rand.choice([0, 3, 50, 1000, 20000])) for _ in range(14)
        }
        w = {level: {f"{level[0]}{k}": float(rand.choice([0, 1, 2, 5])) for k in range(2)} | {"*": float(rand.choice([0, 1, 3]))} for level in mixture.LEVELS}
        w["source"]["*"] = 1.0
        usable = sum(2 * t for p, t in leaves.items() if all(w[lv].get(n, w[lv]["*"]) > 0 for lv, n in zip(mixture.LEVELS, p)))
        budget = int(rand.integers(0, 60000))
        plan, want = planned(spark, leaves, budget, w, 2), plain_plan(leaves, budget, w, mixture.LEVELS, 2)
        assert sum(plan.values()) == min(budget, usable)
        assert set(plan) == set(want) and all(abs(plan[p] - want[p]) <= 3 and plan[p] <= 2 * leaves[p] for p in plan)


def plain_copies(rows, weights, share, epochs, seed):
    """Copies of each (id, text, leaf) row, from scratch."""
    signed = lambda x: x - 2**64 if x >> 63 else x
    h = lambda x, s=42: xxh64_intdigest(x, s)
    n = lambda t: len((t or "").encode().split())
    leaves = Counter()
    for _, t, leaf in rows:
        leaves[leaf] += n(t)
    plan = {p: round(b) for p, b in plain_plan(dict(leaves), int(share * sum(leaves.values())), weights, mixture.LEVELS, epochs).items()}
    out = {}
    for leaf, total in leaves.items():
        full, rest = divmod(plan[leaf], max(1, total))

        def place(row):
            x = 42 if row[0] is None else h(row[0].to_bytes(8, "little", signed=True))
            text = 42 if row[1] is None else h(row[1].encode())
            x = h(text.to_bytes(8, "little"), x)
            x = h(seed.to_bytes(4, "little"), x)
            return signed(h(full.to_bytes(8, "little"), x))

        cum = 0
        groups = {}
        for row in (r for r in rows if r[2] == leaf):
            groups.setdefault(place(row), []).append(row)
        for _, rs in sorted(groups.items()):
            cum += sum(n(t) for _, t, _ in rs)
            for row in rs:
                out.setdefault(row, []).append(full + (rest > 0 and cum <= rest))
    return out


def test_mixture_against_brute_force(spark):
    docs = mixture.with_domain(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = dict(docs.select("doc_id", "text").collect())
    rows = mixture.select(docs).collect()
    want = plain_copies([(r["doc_id"], texts[r["doc_id"]], (r["domain"], r["lang"], r["source"])) for r in rows], mixture.WEIGHTS, 0.8, 3, 20)
    got = {(r["doc_id"], texts[r["doc_id"]], (r["domain"], r["lang"], r["source"])): [r["copies"]] for r in rows}
    # A leaf's budget may round otherwise by a few tokens, which moves the end of its prefix by a row at most.
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in got) <= 20
    mixed = Counter(r["doc_id"] for r in mixture.mix(docs.drop("domain")).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    by = Counter()
    for r in rows:
        by[r["domain"], r["lang"], r["source"]] += r["copies"] * r["n_tokens"]
    assert all(by[r["domain"], r["lang"], r["source"]] <= r["budget"] for r in rows)


def test_mixture_of_repeated_and_null_ids(spark):
    """Rows are told apart by their texts; equal rows are taken together; mix takes what select says."""
    rand = np.random.default_rng(5)
    rows = [(None, " ".join(["w"] * int(k)) + f" t{i}", "en", "src1") for i, k in enumerate(rand.integers(1, 9, 60))]
    rows += [(7, f"some text number {i}", "en", "src1") for i in range(40)] + [(8, "equal words here", "fr", "src1")] * 5 + [(9, None, None, None), (10, "", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("budget", F.lit("mine")).withColumn("tokens", F.lit(3))
    for share in (0.4, 2.5):
        chosen = mixture.select(mixture.with_domain(df), budget_share=share).collect()
        out = mixture.mix(df, budget_share=share)
        assert out.columns == df.columns
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        leaf = {r["domain"] for r in chosen if r["lang"] == "en" and r["source"] == "src1"}.pop()
        want = plain_copies([(i, t, (leaf if s else "dx", ln or "", s or "")) for i, t, ln, s in rows], mixture.WEIGHTS, share, 3, 20)
        assert sum(got.values()) == sum(r["copies"] for r in chosen)
        off = sum(got[k[:2]] != sum(v) for k, v in want.items())
        assert off <= 3 and sum(len((t or "").split()) * n for (_, t), n in got.items()) <= share * sum(len((r[1] or "").split()) for r in rows)
        assert got[8, "equal words here"] % 5 == 0


def test_mixture_edges(spark):
    out = mixture.mix(edge_docs(spark), budget_share=1.0)
    tokens = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert out.columns == edge_docs(spark).columns and tokens(out.collect()) <= tokens(edge_docs(spark).collect())
    assert mixture.mix(edge_docs(spark, [])).count() == 0
    assert mixture.select(mixture.with_domain(edge_docs(spark)), budget_share=0.0).where("copies > 0").count() == 0


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_match_the_mixture(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.interleave(docs, shards).collect()
    by = Counter(r["shard"] for r in rows)
    assert sum(by.values()) == 1000 and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    cell, total = Counter((r["shard"], r["source"]) for r in rows), Counter(r["source"] for r in rows)
    assert all(abs(cell[s, x] - total[x] / shards) <= 2 for s in by for x in total)
    t = dict(docs.select("doc_id", "text").collect())
    assert all(r["size"] == len(t[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(t[r["doc_id"]].encode()) for r in rows)


def test_shard_edges(spark):
    rows = sharding.interleave(edge_docs(spark), 24).collect()
    assert len(rows) == len(EDGES) and {r["slot"] for r in rows} == {0}
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert sharding.interleave(edge_docs(spark, [])).count() == 0


def brute_fingerprint(text, n=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_links(spark):
    t = dict(pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pandas().itertuples(index=False))
    f = {i: brute_fingerprint(x) for i, x in t.items()}
    want = classes(sorted(t), lambda a, b: (f[a] ^ f[b]).bit_count() <= 2)
    rows = simhash.link(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f[i]:016x}", want[i]) for i in t}


def test_range_join_finds_all(spark):
    rand = np.random.default_rng(4)
    base = [int(x) for x in rand.integers(0, 2**63, 40)] + [0, 2**64 - 1, 2**63]
    points = set(base)
    for x in base:
        for k in (1, 2, 2, 3):
            for bit in rand.integers(0, 64, k):
                x ^= 1 << int(bit)
            points.add(x)
    signed = sorted(simhash._signed(x) for x in points)
    got = {(r["a"], r["b"]) for r in simhash.range_join(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_range_join_broadcasts_no_grid(spark):
    # 33 rows for each point, which Spark takes for one: as a broadcast they filled the driver's heap.
    pairs = simhash.range_join(spark.range(300).select(F.col("id").alias("fp")))
    assert pairs.count() == sum(0 < (x ^ y).bit_count() <= 2 for x in range(300) for y in range(x))
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_exploded_keys_are_not_broadcast(spark):
    keys = spark.range(300).select(F.col("id").alias("no"), F.posexplode(F.array(*[F.col("id") % k for k in (2, 7, 400)])).alias("v", "h"))
    pairs = simhash._same_key(keys)
    assert sorted(map(tuple, pairs.collect())) == sorted((x, x % k) for x in range(300) for k in (2, 7))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_edges(spark):
    rows = simhash.link(edge_docs(spark)).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[None]["component_id"] is None
    kept = simhash.dedup(edge_docs(spark))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9, 10] and kept.columns == edge_docs(spark).columns
    assert simhash.link(edge_docs(spark, [])).count() == 0 and simhash.dedup(edge_docs(spark, [])).count() == 0


def cosine(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def test_near_groups(spark):
    rand = np.random.default_rng(6)
    rows, vocab = [], [f"w{i}" for i in range(3000)]
    for g in range(12):
        ws = list(rand.choice(vocab, 200))
        for k in range(6):
            own = list(ws)
            for at in rand.integers(0, 200, k * 2):
                own[at] = str(rand.choice(vocab))
            rows.append((g * 10 + k, " ".join(own)))
    sets = {i: set(simhash.shingle_hashes(x.encode().split(), 5).tolist()) for i, x in rows}
    want = classes([i for i, _ in rows], lambda a, b: cosine(sets[a], sets[b]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, hubs in ((1000, 8), (3, 1)):  # whole groups, and groups dealt over blocks
        kept = simhash.dedup(df, block=block, hubs=hubs).collect()
        assert {r["doc_id"] for r in kept} == set(want.values())
    # One candidate group of everything: most links lie outside the hub's class and between blocks.
    one = df.selectExpr("doc_id", "0L as gid")
    for block, hubs in ((4, 1), (7, 3), (100, 2)):
        links = [(r["a"], r["b"]) for r in simhash._verified_links(df, one, 0.8, 5, block, hubs).collect()]
        assert classes([i for i, _ in rows], lambda a, b: (a, b) in links or (b, a) in links) == want


def test_near_groups_of_short_texts(spark):
    """Texts of 6 to 15 words with their first words or less one end; links are lost by no text of up to SHORT shingles."""
    rand = np.random.default_rng(12)
    rows = []
    for g in range(300):
        ws = [f"s{g}x{i}" for i in range(int(rand.integers(6, 16)))]
        rows.append((g * 10, " ".join(ws)))
        rows.append((g * 10 + 1, " ".join(ws[:-1])))
        rows.append((g * 10 + 2, " ".join(ws[1:])))
    sets = {i: set(simhash.shingle_hashes(x.encode().split(), 5).tolist()) for i, x in rows}
    near = lambda a, b: cosine(sets[a], sets[b]) >= 0.8 - 1e-9
    want = {}
    for g in range(300):
        want |= classes([g * 10, g * 10 + 1, g * 10 + 2], near)
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())
    keys = {i: set(simhash._deletions(np.array(sorted(x), dtype=np.uint64), 0.8)) for i, x in sets.items()}
    for g in range(300):
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = g * 10 + a, g * 10 + b
            assert not near(x, y) or max(len(sets[x]), len(sets[y])) > simhash.SHORT or keys[x] & keys[y]


def test_near_groups_of_all_documents(spark):
    """The stage keeps what a comparison of all pairs keeps, on whole tables."""
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["doc_id", "text"]).to_pandas()
    sets = {i: frozenset(simhash.shingle_hashes(simhash.tokens_of(x), 5).tolist()) for i, x in t.itertuples(index=False)}
    by: dict = {}
    for i, x in sets.items():
        for h in x:
            by.setdefault(h, []).append(i)
    linked = set()
    for i, x in sets.items():
        for j, n in Counter(j for h in x for j in by[h] if j > i).items():
            if n >= 0.8 * math.sqrt(len(x) * len(sets[j])) - 1e-9:
                linked.add((i, j))
    empty = sorted(i for i, x in sets.items() if not x)
    linked |= {(empty[0], i) for i in empty[1:]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    kept = {r["doc_id"] for r in simhash.dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert kept == {find(i) for i in sets}


def test_near_dedup_of_repeated_and_null_ids(spark):
    """Each row is a document of its own: a different text stays, whatever its id."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, "another text with some eight words in it"), (5, "and a third one that nobody else says here"), (None, long),
            (None, "nobody knows the id of this text at all"), (None, "nobody knows the id of this text at all"), (3, long + " more"), (6, "x"), (6, "x")]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, fp int, words string")
    out = simhash.dedup(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect())) == sorted(
        [(3, long + " more"), (5, "another text with some eight words in it"), (5, "and a third one that nobody else says here"),
         (0, "nobody knows the id of this text at all"), (6, "x")]
    )
    got = simhash.link(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a b c"), (2, "p q r"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 2), (2, 2), (2, 2), (4, 2)]


def test_chroma_finds_shifted_noisy_copies(spark):
    rand = np.random.default_rng(7)
    tunes = [chroma.notes(rand.normal(0, 0.25, 96)) for _ in range(12)]
    rows = []
    for i, x in enumerate(tunes):
        noisy = x[4 * chroma.HOP :] + rand.normal(0, 0.02, len(x) - 4 * chroma.HOP)
        for k, y in ((i * 100, x), (i * 100 + 1, noisy)):
            rows.append((k, bytearray((np.clip(y / 2, -1, 1) * 32767).astype("<i2").tobytes())))
    rows += [(5000, None), (5001, bytearray(b"")), (None, bytearray(b"\0\0" * 9000)), (5100, bytearray(b"\0\0" * 9000))]
    df = spark.createDataFrame(rows, "id long, audio binary")
    out = chroma.align(chroma.fingerprints(df, "id", "audio")).collect()
    assert sum(r["kind"] == "member" for r in out) == len(rows)
    pairs = {(r["class_id"], r["other_class"]): r for r in out if r["kind"] == "match"}
    hits = [pairs.get((i * 100, i * 100 + 1)) for i in range(12)]
    assert sum(h is not None and h["frame_offset"] == -4 for h in hits) >= 11
    assert all(a // 100 == b // 100 for a, b in pairs if a < 5000 and b < 5000)
    assert chroma.align(chroma.fingerprints(df.limit(0), "id", "audio")).count() == 0
    # Rows without an id are members, and their class is compared though it has no name; repeated rows; clashing names; null samples.
    vectors = [(100, [0.1 * (i % 7) for i in range(64)]), (None, [0.3 * (i % 2) for i in range(64)]), (200, [0.3 * (i % 2) for i in range(62)] + [None, 0.5]),
               (7, [0.1 * (i % 7) for i in range(64)]), (7, [0.1 * (i % 7) for i in range(64)]), (300, []), (400, [0.1, 0.4] * 4000)]
    odd = spark.createDataFrame([(i, v, "x", [1]) for i, v in vectors], "id long, v array<double>, class string, fp array<int>")
    out = chroma.align(chroma.fingerprints(odd, "id", "v", decode=chroma.notes)).collect()
    names = sorted((r["id"] or 0, r["class_id"]) for r in out if r["kind"] == "member")
    assert [x for x in names if x[0]] == [(7, 7), (7, 7), (100, 7), (200, 200), (300, -1), (400, 400)] and (0, None) in names
    pairs = {(r["class_id"], r["other_class"]) for r in out if r["kind"] == "match"}
    assert {(7, 7), (200, 200), (200, None), (400, 400)} <= pairs


def test_chroma_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = chroma.fingerprints(df, "vec_id", "embedding", decode=chroma.notes)
    out = [r for r in chroma.align(rows).collect() if r["kind"] == "match"]
    fps = {r["id"]: np.array(r["fp"], dtype=np.uint32) for r in rows.select("id", "fp").collect()}
    ids = sorted(fps)
    all_ = np.stack([fps[i] for i in ids])
    n = all_.shape[1]
    want = set()
    for q in (i for i in ids if i % 100 == 0):
        for shift in range(-(n - n // 2), n - n // 2 + 1):
            a, b, k = max(0, -shift), max(0, shift), n - abs(shift)
            error = np.bitwise_count(all_[:, b : b + k] ^ fps[q][None, a : a + k]).sum(axis=1) / (32 * k)
            want |= {(q, ids[j]) for j in np.flatnonzero(error <= chroma.MAX_BER)}
    got = {(r["id"], r["other_class"]) for r in out}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_chroma_finds_every_pair_below_the_stated_error(spark):
    """Pairs without an equal integer are found too; self matches do not count, and lengths differ."""
    rand = np.random.default_rng(9)
    base = [rand.integers(0, 2**32, n, dtype=np.uint32) for n in (40, 64, 90, 200)]
    fps = [*base]
    for x in base:
        for share in (0.1, 0.18, 0.24, 0.3):
            y = x[int(rand.integers(0, 5)) :].copy()
            bits = rand.random((len(y), 32)) < share
            bits[np.arange(len(y)), rand.integers(0, 32, len(y))] = True  # every integer differs
            fps.append(y ^ (bits * (np.uint32(1) << np.arange(32, dtype=np.uint32))).sum(axis=1).astype(np.uint32))
    want = set()
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            for k in range(-len(a) + 32, len(b) - 31):
                n = min(len(a), len(b) - k) - max(0, -k)
                if n >= max(32, min(len(a), len(b)) / 2) and np.bitwise_count(a[max(0, -k) :][:n] ^ b[max(0, k) :][:n]).sum() <= 0.25 * 32 * n:
                    want.add((i, j))
    df = spark.createDataFrame(
        [(i, [int(v) for v in x], bytearray(i.to_bytes(16, "big"))) for i, x in enumerate(fps)], "id long, fp array<long>, class binary"
    )
    out = [r for r in chroma.align(df, every=1).collect() if r["kind"] == "match"]
    assert {(r["id"], r["other_class"]) for r in out} == want and sum(i != j for i, j in want) >= 16
    assert any(r["votes"] == 0 for r in out)


def test_chroma_finds_copies_shifted_by_part_of_a_hop(spark):
    rand = np.random.default_rng(10)
    rows = []
    for i in range(12):
        x = chroma.notes(rand.normal(0, 0.25, 96))
        for k, y in ((i * 100, x), (i * 100 + 1, x[4 * chroma.HOP + chroma.HOP // 2 :])):
            rows.append((k, bytearray((np.clip(y / 2, -1, 1) * 32767).astype("<i2").tobytes())))
    df = spark.createDataFrame(rows, "id long, audio binary")
    out = [r for r in chroma.align(chroma.fingerprints(df, "id", "audio")).collect() if r["kind"] == "match"]
    assert {(i * 100, i * 100 + 1) for i in range(12)} <= {(r["id"], r["other_class"]) for r in out}


def test_parse_quotes():
    own, passages = quotes.parse("yes\n\nOn Monday A wrote:\n> is it?\n> really\n>> before\n> > that\nbye")
    assert own == "yes\n\nbye" and passages == [(1, "is it?\nreally"), (2, "before\nthat")]
    assert quotes.parse(None) == ("", [])


def test_threads(spark):
    m = [
        (1, 1, "x", "Hello  World"), (2, 2, "x", "hi\n> hello world"), (3, 3, "x", "third\n> hi\n> > hello world"), (4, 2, "x", "other\n> HELLO WORLD"),
        (5, 1, "y", "Hello World"), (6, 9, "x", "> no such words\nlost"), (7, 9, None, None), (8, 10, "x", "> lost"), (9, 0, "x", "early\n> hi"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in m], "msg_id long, sent long, scope string, text string, own string")
    got = {r["msg_id"]: r for r in quotes.threads(df).collect()}
    assert {i: r["parent_id"] for i, r in got.items()} == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: None, 7: None, 8: 6, 9: None}
    assert [got[i]["root_id"] for i in (1, 2, 3, 4)] == [1] * 4 and [got[i]["place"] for i in (1, 2, 4, 3)] == [0, 1, 2, 3]
    assert got[3]["own"] == "third" and got[8]["own"] == "" and got[3]["depth"] == 2
    assert quotes.threads(df.limit(0)).count() == 0


def test_threads_of_trimmed_and_interleaved_quotes(spark):
    parent = "We meet on Monday. Bring the\nplans along.\n\nLunch is at noon.\nThe room is blue."
    m = [
        (1, 1, "x", parent), (2, 2, "x", "Other words.\nLunch is at noon."),
        (3, 3, "x", "yes\n> The room is blue."),  # one line
        (4, 3, "x", "fine\n> Bring the plans along."),  # a sentence, wrapped anew
        (5, 3, "x", "> We meet on Monday. Bring the\n> plans along.\ngood\n> Lunch is at noon.\n> The room is blue.\nblue?"),
        (6, 4, "x", "no\n> good\n> > The room is blue."), (7, 4, "y", "no\n> The room is blue."), (8, 0, "x", "no\n> The room is blue."),
        (9, 5, None, "alone. together."), (10, 6, None, "> together."),
    ]
    df = spark.createDataFrame(m, "msg_id long, sent long, scope string, text string")
    got = {r["msg_id"]: r["parent_id"] for r in quotes.threads(df).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: 5, 7: None, 8: None, 9: None, 10: 9}


def test_threads_have_no_circles(spark):
    """Repeated ids at other times, ids that quote each other, null times and null ids, clashing names, very long texts."""
    m = [(1, 1, "x", "first words"), (2, 2, "x", "second words\n> first words"), (1, 3, "x", "third words\n> second words"),
         (3, 4, "x", "fourth\n> third words"), (4, 5, "x", "fifth\n> first words"), (None, 6, "x", "no id\n> fourth"), (None, 7, "x", "none\n> no id"),
         (5, None, "y", "early"), (6, 1, "y", "late\n> early"), (7, None, "y", "too\n> late"), (8, 9, "x", "word " * 30000 + "\n> fifth"), (9, 10, "x", "> " + "word " * 30000),
         (2, 2, "x", "second words\n> first words")]
    df = spark.createDataFrame([(*r, b"n", 1) for r in m], "msg_id long, sent long, scope string, text string, node binary, depth int")
    out = quotes.threads(df).collect()
    assert len(out) == len(m)
    by = {(r["msg_id"], r["own"].split("\n")[0][:12]): r for r in out}
    chain = [(1, "first words"), (2, "second words"), (1, "third words"), (3, "fourth"), (None, "no id"), (None, "none")]
    assert [by[k]["depth"] for k in chain] == list(range(6)) and [by[k]["parent_id"] for k in chain] == [None, 1, 2, 1, 3, None]
    assert {by[k]["root_id"] for k in chain} == {1} and by[4, "fifth"]["parent_id"] == 1 and by[4, "fifth"]["depth"] == 1
    assert by[6, "late"]["parent_id"] == 5 and by[7, "too"]["parent_id"] is None and by[5, "early"]["depth"] == 0
    assert by[8, "word word wo"]["parent_id"] == 4 and by[9, ""]["parent_id"] == 8 and by[9, ""]["depth"] == 3
    places = sorted(r["place"] for r in out if r["root_id"] == 1)
    assert places == list(range(len(places)))


def test_links_against_a_plain_search(spark):
    """Random short messages that quote whole ones, lines or nothing: the parents of a search over all pairs."""
    rand = np.random.default_rng(17)
    words = ["red", "green", "blue", "sky", "sea"]
    say = lambda: "\n".join(" ".join(rand.choice(words, 2)) for _ in range(int(rand.integers(1, 3))))
    rows = []
    for i in range(250):
        text = say()
        if rows and rand.random() < 0.7:
            old = rows[int(rand.integers(len(rows)))][3].split("\n> ")[0].replace("\n", "\n> ")
            text += "\n> " + (old if rand.random() < 0.6 else old.split("\n> ")[-1])
        rows.append((i, int(rand.integers(0, 120)), str(rand.choice(["p", "q"])), text))
    info = []
    for i, sent, scope, text in rows:
        own, passages = quotes.parse(text)
        info.append((sent, i, scope, quotes.normalise(own), quotes.parts_of(own), passages))
    want = {}
    for sent, i, scope, _, _, passages in info:
        earlier = [x for x in info if x[2] == scope and x[0] < sent]
        parent, upto = None, None
        for level, text in sorted(passages, key=lambda x: x[0]):
            found = [x[:2] for x in earlier if x[3] and x[3] == quotes.normalise(text)]
            if found and (upto is None or level == upto):
                parent, upto = max([max(found), *([parent] if parent else [])]), level
        votes = Counter()
        for level in sorted({k for k, _ in passages if upto is None or k < upto}):
            for part in set().union(*(quotes.parts_of(t) for k, t in passages if k == level)):
                if found := [x[:2] for x in earlier if part in x[4]]:
                    votes[max(found)] += 1
            if votes:
                parent = max(votes, key=lambda x: (votes[x], x))
                break
        want[i] = parent and parent[1]
    got = {r["msg_id"]: r["parent_id"] for r in quotes.threads(spark.createDataFrame(rows, "msg_id long, sent long, scope string, text string")).collect()}
    assert got == want and sum(x is not None for x in want.values()) > 80


def test_threads_of_conversations(spark):
    talk = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r["msg_id"]: r for r in queries.QUERIES["op6_quote_threads"](spark, "/root/testdata/sf0.01").collect()}
    rows = talk.select("conv_id", "turn", "text").collect()
    for r in rows:
        g = got[r["conv_id"] * 1048576 + r["turn"]]
        if r["turn"]:
            assert g["parent_id"] == g["msg_id"] - 1 and g["depth"] == r["turn"] and g["place"] == r["turn"]


def test_language_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    bare = pages.selectExpr("page_id", "url", "regexp_replace(html, 'lang=\"[a-z]+\"', '') as html", "1 as host")
    want = {r[0]: r[1] for r in pages.selectExpr("page_id", "regexp_extract(html, 'lang=\"([a-z]+)\"', 1)").collect()}
    got = {r["page_id"]: r["lang"] for r in langid.identify(bare, model).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    odd = spark.createDataFrame([(1, None, None), (2, "nothing", ""), (None, "http://a.fr/x", "<p>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in langid.identify(odd, model).collect()}
    assert len(rows) == 3 and rows[None]["lang"] == "fr" and 0 < rows[1]["probability"] <= 1
    assert langid.identify(odd.limit(0), model).count() == 0


def plain_languages(pages, model):
    """(language, probability) of each page, one page at a time."""
    n, out = len(model.langs), []
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    info = []
    for url, html in pages:
        m = langid.HOST.match(url or "")
        host = m[1].lower().rstrip(".") if m else ""
        t = langid.trigrams(langid.text_of(html))
        logs = np.array([0.2 * float(model.table[k, t].astype(float).sum()) for k in range(n)]) if len(t) else np.zeros(n)
        m = langid.LANG.search(html or "")
        said, last = (langid.code_of(m[1]) if m else None), host.split(".")[-1]
        info.append([host, langid.domain_of(host), last if "." in host and last.isalpha() and 2 <= len(last) <= 24 else None,
                     said if said in model.langs else None, logs - logs.max()])
    p = [soft(x[4]) for x in info]
    world = sum(p)
    for i, x in enumerate(info):
        e, rest = x[4].copy(), np.maximum(world - p[i], 0)
        for key, meaning, trust in ((3, {z: z for z in model.langs}, 0.9), (2, langid.SUFFIXES, 0.7)):
            if x[key] is None:
                continue
            own = np.maximum(sum(q for y, q in zip(info, p) if y[key] == x[key]) - p[i], 0)
            says = meaning.get(x[key])
            prior = [1.0] * n if says not in model.langs else [trust * n if z == says else (1 - trust) * n / (n - 1) for z in model.langs]
            e += np.log((own / np.maximum(rest, 1e-9) * rest.sum() + 20 * np.array(prior)) / (own.sum() + 20))
        x.append(e)
    v = [soft(x[5]) for x in info]
    for i, x in enumerate(info):
        above = np.full(n, 1 / n)
        for same, weight in ((lambda y: True, 1.0), (lambda y: y[1] == x[1], 20.0), (lambda y: y[0] == x[0], 5.0)):
            c = np.maximum(sum(q for y, q in zip(info, v) if same(y)) - v[i], 0)
            above = (c + weight * above) / (c.sum() + weight)
        q = soft(x[5] + np.log(above))
        out.append((model.langs[int(q.argmax())], float(q.max())))
    return out


def test_languages_against_plain_fusion(spark):
    """Posteriors of all pages, a hot host with a third of them among them, and of odd rows."""
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert model.langs == ["de", "en", "es", "fr"]
    rows = [(r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    rows = [(f"http://hot.example.co.uk/{k}" if k % 3 == 0 else u, h) for k, (u, h) in enumerate(rows)]
    rows += [(None, None), ("nothing", ""), ("http://a.b.fr/x", "<p>"), ("http://1.2.3.4/", "<html lang='spa'>la que"), ("http://x.de", "<html lang=xx-yy>"), rows[1], rows[1]]
    rows += [("http://x.es/long", "<html lang=es-MX><p>" + "que la de ".join(["los "] * 30000))]
    df = spark.createDataFrame([(k if k % 5 else None, u, h, 1, "p0") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host int, l0 string")
    got = sorted((r["lang"], round(r["probability"], 6)) for r in langid.identify(df, model).collect())
    want = sorted((x, round(y, 6)) for x, y in plain_languages(rows, model))
    assert [x for x, _ in got] == [x for x, _ in want] and [y for _, y in got] == pytest.approx([y for _, y in want], abs=1e-5)


def test_languages_come_from_the_labels(spark):
    words = {"ita": "ciao come stai oggi questo", "nl": "hoe gaat het met deze dag", "SPA": "hola como estas este dia"}
    docs = spark.createDataFrame([(i, f"{t} " * 5 + str(i), x) for x, t in words.items() for i in range(4)] + [(9, None, "fr"), (10, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["es", "it", "nl"]
    pages = [(1, "http://a.nl", "<p>hoe gaat het</p>"), (2, "http://b.it", "<html lang=ita><p>come stai"), (3, "http://c.com", "<html lang=spa>")]
    out = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    assert {r["page_id"]: (r["lang"], r["declared"]) for r in out} == {1: ("nl", None), 2: ("it", "it"), 3: ("es", "es")}
    none = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), langid.train(docs.limit(0))).collect()
    assert [r["lang"] for r in none] == [None] * 3
    assert [langid.domain_of(x) for x in ("a.b.co.uk", "b.co.uk", "co.uk", "x.example.com", "1.2.3.4", "", "www.gob.mx")] == [
        "b.co.uk", "b.co.uk", "co.uk", "example.com", "1.2.3.4", "", "www.gob.mx"]


def plain_bm25(parts):
    """Impacts of the words of each part, divided by the part's own score."""
    n, mean, df = len(parts), sum(len(p[1]) for p in parts) / len(parts), Counter(w for p in parts for w in set(p[1]))
    out = []
    for _, ws, *_ in parts:
        raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
        out.append({w: x / sum(raw.values()) for w, x in raw.items()})
    return out


def test_wand_equals_all_scores():
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pydict()
    parts = decontam.make_parts(list(zip(items["item_id"], items["text"])))
    index, plain, rand = decontam.Index(parts), plain_bm25(parts), np.random.default_rng(8)
    names = list(index.ids)
    for _ in range(20):
        passages = [sorted(set(rand.choice(len(names), int(rand.integers(1, 90))).tolist()) | {index.ids[w] for w in parts[int(rand.integers(len(parts)))][1][:15]}) for _ in range(4)]
        win, term = np.repeat(np.arange(4), [len(p) for p in passages]), np.concatenate(passages)
        for threshold in (0.1, 0.3, 0.6):
            got = {(w, d): s for w, d, s in zip(*(x.tolist() for x in index.wand(win, term, threshold)))}
            want = {(w, d): sum(x.get(names[t], 0) for t in p) for w, p in enumerate(passages) for d, x in enumerate(plain)}
            want = {k: s for k, s in want.items() if s >= threshold - 1e-9}
            assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("n", [1023, 1025, 4096])
def test_hits_equal_a_plain_search(spark, n):
    """All passages times all parts, and the same from one index and from many slices."""
    rand = np.random.default_rng(n)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    say = lambda k: [str(rand.choice(common)) if rand.random() < 0.5 else str(rand.choice(rare)) for _ in range(k)]
    items = [(i, " ".join(say(int(rand.integers(3, 30))))) for i in range(n)]
    docs = []
    for i in range(15):
        ws = say(int(rand.integers(20, 250)))
        own = decontam.words_of(items[int(rand.integers(n))][1])
        if i % 3 == 1 and len(own) > 6:
            own[len(own) // 2] = "edited"
        at = int(rand.integers(len(ws)))
        docs.append((i if i % 4 else None, " ".join(ws[:at] + (own if i % 3 else []) + ws[at:])))
    docs += [docs[1], docs[2], (7, docs[4][1]), (None, None), (30, "")]
    parts = decontam.make_parts(items)
    plain, want = plain_bm25(parts), []
    for i, text in docs:
        ws, best = decontam.words_of(text), {}
        for w in range(max(0, -(-(len(ws) - 128) // 64)) + 1 if ws else 0):
            passage, have = set(ws[w * 64 : w * 64 + 128]), decontam._shingles(ws[w * 64 : w * 64 + 128])
            for (item, part, q, a), x in zip(parts, plain):
                score = sum(v for t, v in x.items() if t in passage)
                if score < 0.6 - 1e-9:
                    continue
                qo, ao = decontam._held(q, have, ws, w), decontam._held(a, have, ws, w)
                if len(part) < 5:
                    qo = ao = float(f" {' '.join(part)} " in f" {' '.join(ws[w * 64 : w * 64 + 128])} ")
                elif min(qo, ao) < 0.8:
                    share = 1 - decontam._edits(part, ws[max(0, w * 64 - 16) : w * 64 + 144]) / len(part)
                    qo, ao = (share, share) if share >= 0.8 else (qo, ao)
                if min(qo, ao) >= 0.8:
                    best[item] = max(best.get(item, (score, qo, ao)), (score, qo, ao))
        want += [(i or 0, item, *(round(x, 9) for x in v)) for item, v in best.items()]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (1 << 24, 60_000):
        got = [(r[0] or 0, r[1], *(round(x, 9) for x in r[2:])) for r in map(tuple, decontam.hits(df, bench, slice_bytes=slice_bytes).collect())]
        assert len(got) >= 6 and sorted(x[:2] for x in got) == sorted(x[:2] for x in want)
        flat = lambda rows: [v for x in sorted(rows) for v in x[2:]]
        assert flat(got) == pytest.approx(flat(want), abs=1e-7)
        clean = decontam.drop_contaminated(df, bench, slice_bytes=slice_bytes).count()
        assert clean == len(docs) - sum(bool(decontam._search([t], decontam.Index(parts), 0.6)[0]) for _, t in docs)


def test_words_of_scripts_without_spaces():
    assert decontam.words_of("Abc, d_e 12") == ["abc", "d", "e", "12"]
    assert decontam.words_of("\u4eca\u65e5\u306f ok\u3002") == ["\u4eca", "\u65e5", "\u306f", "ok"]
    item = "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u5ea7\u57ce\u5e02\u3002\u7b54\u6848\u662f\u5317\u4eac\u3002"
    index = decontam.Index(decontam.make_parts([(1, item), (2, "\u53e6\u4e00\u4e2a\u95ee\u9898\u5728\u8fd9\u91cc")]))
    got = decontam._search(["\u524d\u6587" * 20 + item + "\u540e\u6587" * 20, "\u524d\u6587" * 40], index, 0.6)
    assert [len(x) for x in got] == [1, 0]


def test_decontamination(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.hits(docs, bench).collect()}
    plain = lambda x: " " + " ".join(decontam.words_of(x)) + " "
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.select("doc_id", "text").collect() for t in [plain(r["text"])] for i, x in items.items() if x in t}
    assert want <= got and len(got - want) <= 0.02 * len(want)
    item = bench.first()["text"]
    odd = edge_docs(spark, [*EDGES, (20, "noise " * 3000 + item.upper() + " noise" * 100)])
    clean = decontam.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(EDGES) and clean.where("doc_id = 20").count() == 0
    assert decontam.hits(odd, bench.limit(0)).count() == 0 and decontam.hits(odd.limit(0), bench).count() == 0


def test_decontamination_finds_edited_copies_and_excerpts():
    rand = np.random.default_rng(11)
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pydict()
    items = list(zip(items["item_id"], items["text"]))
    vocab = [f"v{i}" for i in range(400)]
    long = [str(w) for w in rand.choice(vocab, 192)]
    items.append((-1, " ".join(long)))
    index = decontam.Index(decontam.make_parts(items))
    noise = lambda: " ".join(str(w) for w in rand.choice(vocab, 70))
    texts, want = [], []
    for i, t in items[:-1]:
        ws = decontam.words_of(t)
        for k in range(len(ws)):
            texts += [" ".join(ws[:k] + ["changed"] + ws[k + 1 :]), " ".join(ws[:k] + ["more"] + ws[k:]), " ".join(ws[:k] + ws[k + 1 :])]
            want += [i] * 3
        texts.append(" ".join(ws[: -max(1, len(ws) // 10)]))
        want.append(i)
    for a in range(0, 92):
        texts.append(" ".join(long[a : a + 100]))
        want.append(-1)
    texts = [f"{noise()} {x} {noise()}" for x in texts]
    got = [{index.parts[d][0] for d in hits} for hits in decontam._search(texts, index, decontam.THRESHOLD)]
    assert all(i in found for i, found in zip(want, got))
    assert decontam._edits("a b c d e".split(), "x a b q d e y".split()) == 1
    half = [" ".join(decontam.words_of(t)[: len(decontam.words_of(t)) // 2]) for _, t in items[:-1]]
    assert not any(decontam._search([f"{noise()} {x} {noise()}" for x in half], index, decontam.THRESHOLD))


def test_ordinal_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    fit_on, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = ordinal.train(docs, fit_on)
    assert model.thresholds[0] < model.thresholds[1]
    rows = ordinal.rate(docs, model).join(held, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    good = [r for r in rows if r["quality"] and not r["toxic"]]
    junk = [r for r in rows if not r["quality"] and not r["toxic"]]
    rude = [r for r in rows if r["toxic"]]
    assert len(rude) > 200 and sum(r["keep"] for r in good) >= 0.97 * len(good)
    assert sum(r["keep"] for r in junk) <= 0.1 * len(junk) and sum(r["keep"] for r in rude) <= 0.08 * len(rude)
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)
    kept = ordinal.keep_good(edge_docs(spark), model)
    assert kept.columns == edge_docs(spark).columns and kept.count() <= len(EDGES)
    # Ties, repeated and null ids: each row is rated by its text, and equal texts alike.
    sample = docs.limit(50).collect()
    odd = [(r["doc_id"] if k % 3 else None, r["text"]) for k, r in enumerate(sample)] + [(sample[1]["doc_id"], sample[2]["text"]), (7, sample[3]["text"]), (7, sample[3]["text"])]
    rated = ordinal.rate(spark.createDataFrame([(*r, 1, "x") for r in odd], "doc_id long, text string, tail int, h string"), model).collect()
    want = {t: model.score(t)[1] for _, t in odd}
    assert sorted((r["doc_id"] or -1, round(r["tail"], 9)) for r in rated) == sorted((-1 if i is None else i, round(want[t][-1], 9)) for i, t in odd)
    again = ordinal.train(docs.union(docs.where("doc_id < 500")), fit_on)
    assert again.thresholds == pytest.approx(model.thresholds) and again.weights == pytest.approx(model.weights)
    none = ordinal.train(docs, labels.limit(0))
    assert ordinal.keep_good(edge_docs(spark), none).count() == len(EDGES)
    assert ordinal.rate(edge_docs(spark, []), model).count() == 0


def test_ordinal_fit_against_plain_likelihood():
    """The fitted weights are a stationary point of the cumulative-link likelihood, and probabilities follow its formula."""
    rand = np.random.default_rng(30)
    n, m = 400, 6
    x = rand.random((n, m)) < 0.4
    grade = np.digitize(x @ np.array([2.0, -2, 1, 0, 0, -1]) + rand.logistic(0, 1, n), [-0.7, 0.6])
    row, key = np.nonzero(x)
    shapes = rand.random((n, ordinal.SHAPES))
    model = ordinal.fit(row, key + 100, shapes, grade)
    w = np.array([model.weights[100 + k] for k in range(m)])
    cb = np.cbrt(shapes) - np.array(model.mean)

    def loss(w, v, t):
        f = x @ w + cb @ v
        tail = [np.ones(n), *(1 / (1 + np.exp(c - f)) for c in t), np.zeros(n)]
        p = np.array([tail[g][i] - tail[g + 1][i] for i, g in enumerate(grade)])
        return -np.log(p).mean() + ordinal.RIDGE / 2 * ((w**2).sum() + (v**2).sum() + (np.array(t) ** 2).sum())

    v, t = np.array(model.shape_weights), np.array(model.thresholds)
    best = loss(w, v, t)
    for part in (w, v, t):
        for k in range(len(part)):
            for d in (-0.05, 0.05):
                part[k] += d
                assert loss(w, v, t) > best - 1e-5
                part[k] -= d
    assert abs(w[0] - 2) < 0.8 and abs(w[1] + 2) < 0.8
    df = np.array([[0.0, 9, 0], [5, 0, 0], [3, 30, 60], [0, 1, 2]])
    assert ordinal.telling(df, np.array([10, 100, 200])).tolist() == [False, True, False, False]


def test_line_edges(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (5, "q\nq\nq\nq\nq"), (6, "a\nb"), (None, "b\nc\nd\nz")]
    out = lines.dedup_lines(edge_docs(spark, rows)).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out}
    assert got[None] == ("b\nc\nd\nz", 4, 0)  # a null id sorts first
    assert got[1] == ("a", 4, 3) and got[2] == ("x", 4, 3)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == ("q\nq\nq", 5, 2) and got[6] == ("a\nb", 2, 0)
    assert lines.dedup_lines(edge_docs(spark, [])).count() == 0
    # Rows that share an id, or have none, lose their own lines only.
    rows = [(1, "a\nb\nc"), (9, "x\na\nb\nc"), (9, "p\nimportant1\nimportant2\nimportant3"), (None, "u\nv\nw"), (None, "k\nu\nv\nw"), (9, "p\nimportant1\nimportant2\nimportant3")]
    out = lines.dedup_lines(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")).collect()
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in out)
    mine = [(1, "a\nb\nc", 0), (9, "x", 3), *[(9, "p\nimportant1\nimportant2\nimportant3", 0)] * 2]
    # Of the two texts without an id that share three lines, the one with the smaller hash is the first.
    assert got in (sorted([*mine, (0, "k", 3), (0, "u\nv\nw", 0)]), sorted([*mine, (0, "", 3), (0, "k\nu\nv\nw", 0)]))
