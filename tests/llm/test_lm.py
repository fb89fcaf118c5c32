"""Operator 1 against a plain scorer that handles one token and one bit at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from peerloom.llm import lm_scoring as lm
from test_operators import EDGES, SF, edge_docs

MASK = 2**64 - 1


def final(x):
    x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 29) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 32


def poly(values):
    return sum(v * pow(0xD6E8FEB86659FD93, i, 2**64) for i, v in enumerate(values)) & MASK


def word_hash(w):
    h = 0
    for a in range(0, len(w), 8):
        h = final((h * lm.ODD + int.from_bytes(w[a : a + 8], "little")) & MASK)
    return final(h + len(w) & MASK)


def sequence(text):
    return [*(text or "").encode().lower().replace(b"\x0b", b" ").split(), b"\n"]


class Plain:
    """Scores texts from what was learned: the learned tables, weights and shares are taken, everything else is done anew."""

    def __init__(self, m):
        self.m, self.paths, self.topics = m, m.paths.value, m.topics.value
        self.symbol = {w: i for i, w in enumerate(self.paths.words)}
        self.vocab = {bytes(r["word"]): r for r in m.vocab.collect()}

    def topic(self, ws):
        width = self.topics.centres.shape[1]
        v = np.zeros(width)
        for w in ws:
            s = self.symbol.get(w, width)
            if s < width and s != self.topics.skip:
                v[s] += 1
        v = np.sqrt(v)
        return int(np.argmax(self.topics.centres @ (v / max(np.linalg.norm(v), 1e-9))))

    def path(self, w):
        s = self.symbol.get(w, len(self.paths.words))
        a, n = self.paths.at[s], self.paths.depth[s]
        return list(zip(self.paths.nodes[a : a + n].tolist(), self.paths.bits[a : a + n].tolist()))

    def path_slots(self, ws, i, z, bits):
        """(bit, slots) of each step of token i."""
        p = word_hash(ws[i - 1]) if i else 0
        q = word_hash(ws[i - 2]) if i > 1 else 0
        last = ws[i - 1][-1] if i else 0
        orders = [z + 1, p, p * 3 + q * 0xC2B2AE3D27D4EB4F, last * 64 + z + 1]
        orders = [final((v + k) * lm.ODD & MASK) for k, v in enumerate(orders)]
        for node, bit in self.path(ws[i]):
            yield bit, [self.slot(v, node + 1, bits) for v in orders]

    @staticmethod
    def slot(context, node, bits):
        low = 2**32 - 1
        return (((context >> 32) ^ (node * 0x85EBCA6B & low)) * 0x9E3779B1 & low) >> 32 - bits

    @staticmethod
    def bit_cost(table, mix, slots, bit, lane, own, many, few):
        st, n = [], []
        for s in slots:
            zero, one = (x if x <= 127 else 2 ** (7 + (x - 128) / 8) for x in divmod(int(table[s]), 256))
            zero, one = max(zero - own * (1 - bit), 0), max(one - own * bit, 0)
            st.append(math.log((one + lm.PRIOR) / (zero + lm.PRIOR)))
            n.append(zero + one)
        level = lambda steps, x: sum(x > s for s in steps)
        gate = level([0.5, 2.5, 8.5, 64.5, 1024.5], n[few]) * 4 + level([0.5, 16.5, 1024.5], n[many])
        x = min(7.99, max(-7.99, sum(a * b for a, b in zip(st, mix.weights[gate]))))
        at = (x + 8) * 2
        low = int(at)
        y = mix.map[lane][low] * (1 - at + low) + mix.map[lane][low + 1] * (at - low)
        return -math.log10(1 + math.exp((0.5 - bit) * (x + y)))

    def spelling(self, w, z, own):
        table, bits = self.m.spell_table.value, (len(self.m.spell_table.value) - 1).bit_length()
        raw, out = (w if w == b"\n" else w + b" "), 0.0
        for pos, byte in enumerate(raw):
            hashes, h = [min(pos, 15)], 0
            for k in range(1, 5):
                h = (h * 0x100000001B3 + ((raw[pos - k] + 1) * lm.ODD if pos >= k else 0)) & MASK
                hashes.append(h)
            hashes.append((poly([b + 1 for b in raw[:pos]]) + pos * 0xA24BAED4963EE407) & MASK)
            salt = z * 0xC2B2AE3D27D4EB4F
            mixed = [final((v + k + 1 + (0 if k in (3, 4) else salt)) & MASK) for k, v in enumerate(hashes)]
            node = 1
            for b in range(7, -1, -1):
                bit = byte >> b & 1
                slots = [self.slot(v, node, bits) for v in mixed]
                out += self.bit_cost(table, self.m.spell_mix, slots, bit, 7 - b, own, 3, 5)
                node = node * 2 + bit
        return out

    def score(self, text, held):
        m, ws, own = self.m, sequence(text), 0 if held else 1
        z, bits = self.topic(ws), (len(m.path_table.value) - 1).bit_length()
        hs = [word_hash(w) for w in ws]
        runs, at = [], 0
        for i in range(len(ws)):
            p, q = (hs[i - 1] if i else 0), (hs[i - 2] if i > 1 else 0)
            cut = final((hs[i] * lm.ODD + p * 0xC2B2AE3D27D4EB4F + q * 0x165667B19E3779F9) & MASK) % lm.RUN == 0
            if cut or i == len(ws) - 1:
                runs.append((at, i + 1))
                at = i + 1
        names = [b" " + final(poly(hs[a:e])).to_bytes(8, "little") if e - a >= lm.LEAST_RUN else None for a, e in runs]
        times, before, flags, last, total = Counter(names), Counter(), [list(x) for x in lm.FLAGS], 0, float(self.topics.cost[z])
        for (a, e), name in zip(runs, names):
            plain = 0.0
            for i in range(a, e):
                for lane, (bit, slots) in enumerate(self.path_slots(ws, i, z, bits)):
                    plain += self.bit_cost(m.path_table.value, m.path_mix, slots, bit, min(lane, 7), own, 1, 2)
                if ws[i] not in self.symbol:
                    r = self.vocab[ws[i]]
                    c, cz = r["c"], r["cz"][z]
                    p = m.blend[0] * 10 ** self.spelling(ws[i], z, min(cz, 1))
                    p += m.blend[1] * max(cz - own, 0) / max(m.by_topic[z] - own, 1) + m.blend[2] * max(c - own, 0) / max(m.rare - own, 1)
                    plain += math.log10(p)
            known = self.vocab[name]["c"] if name in self.vocab else 0
            known, n = (known - own * times[name] + before[name] if name else 0), sum(flags[last])
            before[name] += 1
            plain += math.log10(flags[last][0] / n)
            named = math.log10(min(1, known / (m.runs + 1)) * flags[last][1] / n) if known > 0 else -math.inf
            pick = int(named > plain)
            total += max(plain, named)
            flags[last][pick] += 1
            last = pick
        return total


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    rows = docs.collect()
    extra = [(1000 + i, r["text"]) for i, r in enumerate(rows[:4])] + [(2000, None), (2001, ""), (None, "no id"), (2002, "the of " * 40)]
    return docs.union(spark.createDataFrame(extra, "doc_id long, text string")).coalesce(1)


def test_same_as_a_plain_scorer(spark, small):
    m = lm.learn(lm._rows(small))
    plain = Plain(m)
    rows = small.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["score"]) for r in lm.score(small).collect()))
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, plain.score(r["text"], held(r["doc_id"]))) for r in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=2e-5)
    # The path table holds the bits of all training tokens.
    bits = (len(m.path_table.value) - 1).bit_length()
    table = defaultdict(int)
    for r in rows:
        if not held(r["doc_id"]):
            ws = sequence(r["text"])
            z = plain.topic(ws)
            for i in range(len(ws)):
                for bit, slots in plain.path_slots(ws, i, z, bits):
                    for s in slots:
                        table[s, bit] += 1
    full = m.path_table.value
    step = lambda n: n if n <= 127 else min(255, 128 + math.floor(8 * math.log2(n / 128) + 1e-9))
    want = np.zeros(len(full), dtype=np.int64)
    for (s, bit), n in table.items():
        want[s] += step(n) * (1 if bit else 256)
    assert (full == want).all()
    # Word order counts, in texts that were seen nowhere too.
    ws = sequence(rows[10]["text"])[:-1]
    shuffled = random.Random(3).sample(ws, len(ws))
    assert abs(plain.score(b" ".join(ws).decode(), True) - plain.score(b" ".join(shuffled).decode(), True)) > 1e-3
    assert abs(plain.score(b" ".join(shuffled).decode(), True) - plain.score(b" ".join(sorted(ws)).decode(), True)) > 1e-3


def test_base_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.score(docs.withColumnRenamed("lang", "word").withColumnRenamed("source", "chunk")).collect()}
    t = dict(docs.select("doc_id", "text").collect())
    tokens = {i: sequence(x) for i, x in t.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in t}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(t)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens[i]), n)
        assert r["n_known"] == sum(c[w] > 0 for w in tokens[i]) and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0 and r["n_bytes"] == len(t[i].encode()) + 1


def test_held_out_cost_and_copies(spark):
    """Held-out texts cost clearly less than by the base, and copies across the split far less than other texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lm.score(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    bits = lambda key: -sum(r[key] for r in held) / math.log10(2) / sum(r["n_bytes"] for r in held)
    assert bits("score") < 0.9 * bits("base_score") and bits("score") < 2
    training = Counter(r["text"] for r in rows if not r["held_out"])
    twice = [r["bits_per_byte"] for r in rows if len(r["text"].split()) >= 50 and training[r["text"]] - (not r["held_out"]) > 0]
    rest = [r["bits_per_byte"] for r in rows if len(r["text"].split()) >= 50 and training[r["text"]] - (not r["held_out"]) <= 0]
    assert twice and max(twice) < 0.7 and np.median(rest) > 1.5


def test_costs_are_a_distribution():
    """Over all one-byte and all two-byte words the spellings' probabilities sum to no more than one, and so do all paths'."""
    words = [b"ab", b"abc", b"b", b"\n"] * 5
    z, c = np.zeros(len(words), int), np.ones(len(words))
    table = lm.states(lm.count_spelling(words, z, c, 14))
    mix = lm.Mix(lm.SPELL_ORDERS)
    lm.spell(words, z, c, table, mix, learn=True)
    ends = {9, 11, 12, 13, 32}
    some = [bytes([a]) for a in range(256) if a not in ends] + [bytes([a, b]) for a in range(256) for b in range(256) if not {a, b} & (ends | {10})]
    total = float((10 ** lm.spell(some, np.zeros(len(some), int), np.zeros(len(some)), table, mix)).sum())
    assert 0.05 < total <= 1 + 1e-6
    names = [bytes([97 + i]) for i in range(20)]
    paths = lm.Paths(names, list(range(1, 21)), 7)
    assert sum(2.0 ** -d for d in paths.depth) == 1
    total = 0.0
    for w in [*names, b"rare"]:
        data = np.frombuffer(b"c a " + w, dtype=np.uint8)
        tokens = lm.Tokens(data, np.array([0, len(data)]))
        rand = np.random.default_rng(1).integers(0, 9, (1 << 12, 2))
        total += 10 ** lm.path_costs(tokens, paths, np.zeros(1, int), lm.states(rand), lm.Mix(lm.PATH_ORDERS), np.ones(1))[2]
    assert total == pytest.approx(1)


def test_edges(spark):
    got = lm.score(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert [r["n_tokens"] for r in empty] == [1, 1] and all(r["n_bytes"] == 1 for r in empty)
    assert next(r for r in got if r["doc_id"] is None)["n_tokens"] == 3
    assert lm.score(edge_docs(spark, [])).count() == 0
    none = [(i, "a few words") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm.score(edge_docs(spark, none)).collect()
    assert len(rows) == len(none) and all(r["train_tokens"] == r["n_known"] == 0 and r["score"] < 0 for r in rows)
    big = [(2**62 + i, "large ids with null ids beside them") for i in range(3)] + [(None, "null")]
    assert {r["doc_id"] for r in lm.score(edge_docs(spark, big)).collect()} == {2**62, 2**62 + 1, 2**62 + 2, None}


def test_words_and_runs_travel_packed(spark, small):
    """Stored and shuffled tables have a row for each bucket (and chunk), not for each distinct word; no word is lost or counted twice."""
    docs = small.repartition(3, "doc_id").localCheckpoint()
    m = lm.learn(lm._rows(docs))
    assert m.packed.count() <= 2 ** lm.BUCKET_BITS[0]
    plan = lm.score(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CoGroups" in plan
    plain = Plain(m)
    c, cz, runs, times = Counter(), Counter(), Counter(), Counter()
    for r in docs.collect():
        ws, n = sequence(r["text"]), int(zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2)
        z, hs, at = plain.topic(ws), [word_hash(w) for w in ws], 0
        for i, w in enumerate(ws):
            if w not in plain.symbol:
                c[w] += n
                cz[w, z] += n
            p, q = (hs[i - 1] if i else 0), (hs[i - 2] if i > 1 else 0)
            if i == len(ws) - 1 or final((hs[i] * lm.ODD + p * 0xC2B2AE3D27D4EB4F + q * 0x165667B19E3779F9) & MASK) % lm.RUN == 0:
                if i + 1 - at >= lm.LEAST_RUN:
                    name = b" " + final(poly(hs[at : i + 1])).to_bytes(8, "little")
                    runs[name] += n
                    times[name] += 1
                at = i + 1
    got = {bytes(r["word"]): r for r in m.vocab.collect()}
    assert {w: r["c"] for w, r in got.items()} == dict(c) | {x: n for x, n in runs.items() if n and times[x] > 1}
    assert {(w, k) for w, r in got.items() if w[:1] != b" " for k in range(lm.TOPICS) if r["topics"] >> k & 1} == set(cz)
    assert all(got[w]["cz"][k] == n for (w, k), n in cz.items())
    assert (m.rare, m.runs) == (sum(c.values()), sum(runs.values()))
    assert m.by_topic == [sum(n for (_, k), n in cz.items() if k == t) for t in range(lm.TOPICS)]


def test_shared_beginnings_are_spelled_once(monkeypatch):
    """Words together are counted and priced as each alone, and only distinct beginnings are worked on."""
    rand = random.Random(5)
    words = sorted({b"anti" + bytes(rand.choices(b"abc", k=rand.randint(1, 9))) for _ in range(900)}) + [b"\n", b"anti"]
    z = np.array([rand.randrange(3) for _ in words])
    c = np.array([rand.choice([0, 1, 2, 300]) for _ in words])
    worked, bits_of = [], lm._bits
    monkeypatch.setattr(lm, "_bits", lambda raw, *a: (worked.append(len(raw)), bits_of(raw, *a))[1])
    got = lm.count_spelling(words, z, c, 14)
    starts = {(w if w == b"\n" else w + b" ")[: i + 1] + bytes([k]) for w, k in zip(words, z) for i in range(len(w) + (w != b"\n"))}
    assert sum(worked) == len(starts) < sum(len(w) + 1 for w in words) / 2
    alone = sum(lm.count_spelling([w], z[i : i + 1], c[i : i + 1], 14) for i, w in enumerate(words))
    assert (got == alone).all()
    mix = lm.Mix(lm.SPELL_ORDERS)
    lm.spell(words, z, np.maximum(c, 1), lm.states(got), mix, learn=True)
    together = lm.spell(words, z, c, lm.states(got), mix)
    assert together == pytest.approx([lm.spell([w], z[i : i + 1], c[i : i + 1], lm.states(got), mix)[0] for i, w in enumerate(words)], rel=1e-5)
