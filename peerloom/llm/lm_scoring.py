"""Operator 1: language-model scoring by online logistic context mixing.

A text is its lower-cased words and one end token. Each token is coded in bits:

* A Huffman path over the corpus's frequent words and one escape. Four
  hashed-context predictors (topic; previous word; previous two words; last byte
  of the previous word with the topic) give a probability for every bit. A mixer combines their logits by weights that a
  gate picks (how much the corpus has seen of the one- and two-word contexts);
  an adaptive map refines the mixed logit. So contexts reach over word ends.
* After an escape, the bytes of the word. Six byte predictors, mixed and refined
  in the same manner, spell it; each distinct word of a topic is spelled once.
  The spelling is blended with the word's share of topic and corpus.
* A run of words (cut where a hash of three words says so, 24 words on average)
  that the training texts hold elsewhere may instead be named as a whole, if its
  flag and share cost less: a document that occurs twice is far cheaper.

Weights and maps are learned online, block by block, on every training token
(spelling: every distinct training word, weighted by its count), by each
task or group of words alone, and averaged by what each has seen. A training
text is always scored with its own occurrences taken out of path counts, shares
and runs; the spelling of any known word has one occurrence taken out.

A topic is a class of texts, coded before the text. Texts are grouped by
their commonest frequent word, the mean word vectors of these groups are summed
over all training texts, and the driver clusters the groups (at most
TOPIC_WORDS of them).

What grows with the corpus stays distributed: word counts, runs and spelling
costs travel to bounded chunks of documents once for each distinct word or run,
packed as arrays by buckets of their hashes (two words with one 64-bit hash are
not to be expected). Equal beginnings of words are spelled once.
The driver holds the frequent words (at most FREQUENT, each task naming its own
most frequent candidates; their counts are exact) and two hashed tables whose
slots grow with the corpus up to what a broadcast bears.

Edge cases: null text is empty and has the end token only; a null doc_id is
the empty text for the split (not held out); repeated rows are scored and
counted each (the other copies are not taken out, so each finds its runs); words
of any length are coded whole; an empty table gives no rows, and without any
training token the costs are those of untrained predictors; extra columns are
ignored. The texts are read several times; if a later scan cuts other chunks
(an input that is not deterministic), scoring stops with an error.
"""

from __future__ import annotations

import functools
import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FOLDS, HELD = 7, 2
#: Frequent words that have a path of their own, and those that describe a topic.
FREQUENT, TOPICS, TOPIC_WORDS = 127, 8, 127
#: Most slots of the tables: two bytes each on every worker.
PATH_BITS, SPELL_BITS = 21, 21
#: Bytes of text in a chunk, and in the pieces in which it is read.
CHUNK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Mean and least number of words of a run that can be named as a whole.
RUN, LEAST_RUN = 24, 4
#: Counts that the flag of a run starts with: (spelled, named) after a spelled and after a named run.
FLAGS = ((8.0, 0.25), (1.0, 2.0))
PRIOR, RATE, APM_STEPS, GATES, LANES = 0.4, 0.2, 33, 24, 8
PATH_ORDERS, SPELL_ORDERS = 4, 6
#: Least and most bits of a hash that number the buckets of words and runs; between them a bucket has about 2^17 training tokens.
BUCKET_BITS = (6, 12)
#: Distinct words of a group that learns the spelling weights together.
GROUP = 1 << 17
END = b"\n"
ODD = 0x9E3779B97F4A7C15


def _final(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int):
    import numpy as np

    out = np.full(max(1, n), 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sums(values, sizes):
    """Hash of each run of consecutive ``values``: a sum of value * odd^position, exact modulo 2^64."""
    import numpy as np

    first = np.cumsum(sizes) - sizes
    pos = np.arange(len(values)) - np.repeat(first, sizes)
    return np.add.reduceat(values * _powers(int(sizes.max()))[pos], first) if len(sizes) else np.zeros(0, np.uint64)


def _words(data, start, size):
    """Hashes of words: each eight bytes (the last ones filled up with zeros) and then the length are mixed in."""
    import numpy as np

    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    h, at = _final(eight[start] & masks[np.minimum(size, 8)]), 8
    live = np.flatnonzero(size > 8)
    while len(live):
        part = eight[start[live] + at] & masks[np.minimum(size[live] - at, 8)]
        h[live] = _final(h[live] * np.uint64(ODD) + part)
        at += 8
        live = live[size[live] > at]
    return _final(h + size.astype(np.uint64))


def hash_of(words: list[bytes]):
    """Hashes of words, as ``Tokens`` has them."""
    import numpy as np

    size = np.array([len(w) for w in words], dtype=np.int64)
    return _words(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size, size)


@functools.cache
def _end_hash():
    return hash_of([END])[0]


class Tokens:
    """All tokens of some texts: ``start`` and ``size`` in ``data`` (the end token has start -1), ``hash``, ``doc``;
    ``first`` has the place of each text's first token and the number of tokens."""

    def __init__(self, data, offsets):
        """``data``: lower-cased bytes; text i lies between offsets i and i + 1."""
        import numpy as np

        parts, base, n = [], 0, len(offsets) - 1
        while base < n:  # pieces that stay in the cache
            stop = max(base + 1, int(np.searchsorted(offsets, offsets[base] + PIECE_BYTES, "right")) - 1)
            parts.append(self._piece(data, offsets[base : stop + 1], base))
            base = stop
        self.data = data
        self.start, self.size, self.hash, self.doc = (
            np.concatenate(x) if parts else np.zeros(0, t)
            for x, t in zip(zip(*parts) if parts else [[]] * 4, (np.int32, np.int32, np.uint64, np.int32))
        )
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    @staticmethod
    def _piece(data, offsets, base):
        import numpy as np

        x = data[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        # With a space on either side and between texts, a word is where the mask changes.
        inside = ~((x == 32) | ((x >= 9) & (x <= 13)))
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        edge = at[:-1][(at[:-1] < len(x)) & (np.diff(at) > 0)]
        head[edge] = inside[edge]
        edge = at[1:][np.diff(at) > 0] - 1
        tail[edge] = inside[edge]
        starts = np.flatnonzero(head)
        sizes = np.flatnonzero(tail) - starts + 1
        hashes = _words(x, starts, sizes)
        many = np.diff(np.searchsorted(starts, at))
        n = len(many)
        doc = np.repeat(np.arange(n), many)
        own, end = np.arange(len(starts)) + doc, np.cumsum(many) + np.arange(n)
        start, size, d = (np.empty(len(starts) + n, dtype=np.int32) for _ in range(3))
        h = np.empty(len(start), dtype=np.uint64)
        start[own], size[own], h[own], d[own] = starts + offsets[0], sizes, hashes, doc + base
        start[end], size[end], h[end], d[end] = -1, 1, _end_hash(), np.arange(n) + base
        return start, size, h, d

    def symbols(self, paths):
        """The symbols of all tokens, found once for each ``paths``."""
        if getattr(self, "_paths", None) is not paths:
            self._paths, self._symbols = paths, paths.symbols(self.hash)
        return self._symbols

    def words(self, at) -> list[bytes]:
        return [END if s < 0 else self.data[s : s + n].tobytes() for s, n in zip(self.start[at].tolist(), self.size[at].tolist())]

    def before(self):
        """Hashes of the word before each token and of the one before that; 0 outside the text."""
        import numpy as np

        out = []
        for h in (self.hash, None):
            h = np.roll(out[0] if h is None else h, 1)
            h[self.first[:-1]] = 0
            out.append(h)
        return out

    def runs(self):
        """(first token, number of tokens, hash) of each run."""
        import numpy as np

        p, q = self.before()
        cut = _final(self.hash * np.uint64(ODD) + p * np.uint64(0xC2B2AE3D27D4EB4F) + q * np.uint64(0x165667B19E3779F9)) % np.uint64(RUN) == 0
        cut[self.first[1:] - 1] = True
        stop = np.flatnonzero(cut) + 1
        at = np.concatenate([[0], stop[:-1]])
        return at, stop - at, _final(_sums(self.hash, stop - at))


class Paths:
    """Huffman paths of the frequent words, given with their counts, and of the escape (the last symbol)."""

    def __init__(self, words: list[bytes], counts: list[int], escapes: int):
        import numpy as np

        self.words, self.counts = words, np.array([*counts, escapes], dtype=np.int64)
        heap = [(int(c), i, i) for i, c in enumerate(self.counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        node = 0
        while len(heap) > 1:
            (c, _, x), (d, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (-1 - node, 0), (-1 - node, 1)
            heapq.heappush(heap, (c + d, len(self.counts) + node, -1 - node))
            node += 1
        nodes, bits, depth = [], [], []
        for i in range(len(self.counts)):
            path, x = [], i
            while x in up:
                x, bit = up[x]
                path.append((-1 - x, bit))
            depth.append(len(path))
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        self.nodes, self.depth = np.array(nodes, dtype=np.int64), np.array(depth, dtype=np.int64)
        self.bits, self.at = np.array(bits, dtype=np.int32), np.cumsum(self.depth) - self.depth
        self.salt = (self.nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        # The words by 16 bits of their hashes; of several with the same bits all but one are in later layers.
        h = hash_of(words) if words else np.zeros(0, np.uint64)
        self.layers, left = [], np.arange(len(words))
        while len(left):
            slot = (h[left] >> np.uint64(48)).astype(np.intp)
            _, first = np.unique(slot, return_index=True)
            layer = np.full(1 << 16, -1, dtype=np.int32)
            layer[slot[first]] = left[first]
            self.layers.append(layer)
            left = np.delete(left, first)
        self.hashes = np.append(h, np.uint64(0))

    def symbols(self, hashes):
        import numpy as np

        slot, out = (hashes >> np.uint64(48)).astype(np.intp), np.full(len(hashes), len(self.words), dtype=np.int32)
        for layer in self.layers:
            found = layer[slot]
            out = np.where((found >= 0) & (self.hashes[found] == hashes), found, out)
        return out


#: A slot's state has two bytes, a step of the count of zeros and one of ones: exact to 127, then eight steps an octave.
EXACT, OCTAVE = 127, 8


def states(counts):
    """uint16 state of each row of counts (zeros, ones)."""
    import numpy as np

    n = counts.astype(np.float64)
    step = np.where(n <= EXACT, n, np.minimum(255, EXACT + 1 + np.floor(OCTAVE * np.log2(np.maximum(n, 1) / (EXACT + 1)) + 1e-9)))
    return (step[:, 0] * 256 + step[:, 1]).astype(np.uint16)


@functools.cache
def _lookup():
    """For each state, as it stands and less one zero or one one: the logit, and the parts of the gate that a short and a
    long context give."""
    import numpy as np

    step = np.arange(256)
    n = np.where(step <= EXACT, step, (EXACT + 1) * 2.0 ** ((step - EXACT - 1) / OCTAVE))
    zero, one = np.repeat(n, 256), np.tile(n, 256)
    zero = np.concatenate([zero, np.maximum(zero - 1, 0), zero])
    one = np.concatenate([one, one, np.maximum(one - 1, 0)])
    few = np.searchsorted([0.5, 2.5, 8.5, 64.5, 1024.5], zero + one) * 4
    many = np.searchsorted([0.5, 16.5, 1024.5], zero + one)
    return np.log((one + PRIOR) / (zero + PRIOR)).astype(np.float32), many.astype(np.uint8), few.astype(np.uint8)


def evidence(table, slots, bit, own, many: int, few: int):
    """(logits of all orders, gates), the bits that are a text's own taken out; ``many`` and ``few`` are the gate's orders."""
    import numpy as np

    logit, short, long = _lookup()
    kind = (own * (1 + bit)).astype(np.intp) << 16
    at = [table.take(s, mode="clip") + kind for s in slots]  # clip: the slots are not searched for ones out of bounds
    return [logit.take(x, mode="clip") for x in at], (short.take(at[many], mode="clip") + long.take(at[few], mode="clip")).astype(np.intp)


class Mix:
    """Gated mixing weights and the refining map (a row for each lane), learned online."""

    def __init__(self, orders: int):
        import numpy as np

        self.weights = np.full((GATES, orders), 1.5 / orders)
        self.map = np.tile(np.linspace(-8, 8, APM_STEPS), (LANES, 1))
        self.seen, self.used = np.zeros(GATES), np.zeros((LANES, APM_STEPS))

    def logits(self, st, gate, lane):
        """Mixed logit, refined logit, and the steps of the map between which the mixed one lies."""
        import numpy as np

        weights, y = self.weights.astype(np.float32), self.map.astype(np.float32).ravel()
        weights = np.ascontiguousarray(weights.T)
        x = st[0] * weights[0].take(gate, mode="clip")
        for k in range(1, len(st)):
            x += st[k] * weights[k].take(gate, mode="clip")
        np.clip(x, -7.99, 7.99, out=x)
        at = (x + np.float32(8)) * np.float32(2)
        low = at.astype(np.intp)
        share = at - low.astype(np.float32)
        low += lane * APM_STEPS
        below = y[low]
        return x, below + (y[low + 1] - below) * share, low, share

    def cost(self, st, gate, lane, bit):
        """Natural log of the probability of each bit."""
        import numpy as np

        x, y, _, _ = self.logits(st, gate, lane)
        return -np.log(1 + np.exp((np.float32(0.5) - bit.astype(np.float32)) * (x + y)))

    def learn(self, st, gate, lane, bit, weight=None, times=None):
        """As ``cost``, then one step of the weights and of the map. ``weight`` and ``times``: for each bit the sum of the weights, and
        the number, of the equal bits that it stands for."""
        import numpy as np

        x, y, low, share = self.logits(st, gate, lane)
        sign = bit.astype(np.float32) * np.float32(2) - np.float32(1)
        err = sign / (1 + np.exp(sign * x))
        err = err if weight is None else err * weight
        n = np.bincount(gate, weights=times, minlength=GATES)
        for k, s in enumerate(st):
            self.weights[:, k] += RATE * np.bincount(gate, weights=err * s, minlength=GATES) / (n + 16.0)
        self.seen += n
        err = sign / (1 + np.exp(sign * y))
        err = err if weight is None else err * weight
        size = LANES * APM_STEPS
        for i, f in ((low, 1 - share), (low + 1, share)):
            n = np.bincount(i, weights=f if times is None else f * times, minlength=size)
            self.map += (RATE * np.bincount(i, weights=err * f, minlength=size) / (n + 16.0)).reshape(self.map.shape)
            self.used += n.reshape(self.map.shape)
        return -np.log(1 + np.exp(np.float32(-0.5) * sign * (x + y)))

    def state(self):
        """What is summed over learners: weights and map times what each has seen, and that."""
        import numpy as np

        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, (self.map * self.used).ravel(), self.used.ravel()])

    def take(self, state) -> Mix:
        """The average of the learners whose states were summed; what none has seen stays as it is."""
        import numpy as np

        a, b, c = self.weights.size, GATES, self.map.size
        w, seen, m, used = np.split(state, [a, a + b, a + b + c])
        w, m, used = w.reshape(self.weights.shape), m.reshape(self.map.shape), used.reshape(self.map.shape)
        self.weights = np.where(seen[:, None] > 0, w / np.maximum(seen, 1)[:, None], self.weights)
        self.map = np.where(used > 0, m / np.maximum(used, 1e-9), self.map)
        return self


def _slot(context, node, bits: int):
    """Slots of 32-bit context hashes at the nodes."""
    import numpy as np

    return (((context ^ node) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.intp)


def _high(x):
    import numpy as np

    return (_final(x) >> np.uint64(32)).astype(np.uint32)


def decisions(tokens: Tokens, paths: Paths, topic, bits: int, most: int = 1 << 13):
    """Blocks of (first token, last token, owner, bit, lane, slots of each order): the bits of the paths of all tokens."""
    import numpy as np

    p, q = tokens.before()
    symbol, topic = tokens.symbols(paths), topic.astype(np.uint64) + np.uint64(1)
    for a in range(0, len(symbol), most):
        z = min(len(symbol), a + most)
        own, p_, q_ = topic[tokens.doc[a:z]], p[a:z], q[a:z]
        last = np.zeros(z - a, dtype=np.uint64)
        has = np.flatnonzero(p_) + a
        last[has - a] = tokens.data[tokens.start[has - 1] + tokens.size[has - 1] - 1]
        orders = [own, p_, p_ * np.uint64(3) + q_ * np.uint64(0xC2B2AE3D27D4EB4F), last * np.uint64(64) + own]
        orders = [_high((v + np.uint64(k)) * np.uint64(ODD)) for k, v in enumerate(orders)]
        depth = paths.depth[symbol[a:z]]
        owner = np.repeat(np.arange(z - a), depth)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
        at = paths.at[symbol[a:z]][owner] + step
        node = paths.salt[at]
        yield a, z, owner, paths.bits[at], np.minimum(step, LANES - 1), [_slot(v[owner], node, bits) for v in orders]


def path_costs(tokens: Tokens, paths: Paths, topic, table, mix: Mix, held, learn: bool = False):
    """log10 of each token's path; ``learn`` also moves the mixer."""
    import numpy as np

    out = np.zeros(len(tokens.hash))
    bits = (len(table) - 1).bit_length()
    own = (held[tokens.doc] == 0).astype(np.int32)
    for a, z, owner, bit, lane, slots in decisions(tokens, paths, topic, bits):
        st, gate = evidence(table, slots, bit, own[a:z][owner], 1, 2)
        out[a:z] = np.bincount(owner, weights=(mix.learn if learn else mix.cost)(st, gate, lane, bit), minlength=z - a)
    return out / np.log(10)


class Topics:
    """Classes of texts by their frequent words; the class is part of a text's code and costs log10 of its share."""

    def __init__(self, sums, many, skip: int):
        """``sums``: for each frequent word, the sum of the unit vectors of the texts in which it is the commonest;
        ``many``: how many texts. ``skip``: the end token's column, which says nothing."""
        import numpy as np

        self.skip = skip
        use = np.flatnonzero(many > 0)
        x = sums[use] / np.maximum(np.linalg.norm(sums[use], axis=1, keepdims=True), 1e-9) if len(use) else np.zeros((1, sums.shape[1]))
        n = many[use] if len(use) else np.ones(1)
        pick = [int(np.argmax(n))]  # the largest group, then always the one that is farthest and large
        while len(pick) < TOPICS:
            pick.append(int(np.argmax(n * np.clip(1 - (x @ x[pick].T).max(axis=1), 0, None))))
        self.centres = x[pick]
        for _ in range(20):
            z = np.argmax(x @ self.centres.T, axis=1)
            total = np.stack([(x * n[:, None])[z == k].sum(axis=0) if (z == k).any() else self.centres[k] for k in range(TOPICS)])
            self.centres = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        share = np.bincount(np.argmax(x @ self.centres.T, axis=1), weights=n, minlength=TOPICS) + 1.0
        self.cost = np.log10(share / share.sum())

    @staticmethod
    def vectors(tokens: Tokens, paths: Paths, width: int, skip: int):
        """Unit vectors of the roots of the counts of the first ``width`` symbols, a row for each text."""
        import numpy as np

        symbol, n = tokens.symbols(paths), len(tokens.first) - 1
        ok = (symbol < min(width, len(paths.words))) & (symbol != skip)
        v = np.sqrt(np.bincount(tokens.doc[ok] * width + symbol[ok], minlength=n * width).reshape(n, width))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def of(self, tokens: Tokens, paths: Paths):
        return (self.vectors(tokens, paths, self.centres.shape[1], self.skip) @ self.centres.T).argmax(axis=1)


# ---- spelling ----------------------------------------------------------------------------------


def _contexts(words: list[bytes], topic):
    """The bytes of all words with their closing byte, the word of each, a context hash for each order and byte, and a hash of topic,
    word so far and byte: bytes with the same one cost the same.

    All orders but the three- and four-byte ones are counted for each topic apart.
    """
    import numpy as np

    raw = np.frombuffer(b"".join(w if w == END else w + b" " for w in words), dtype=np.uint8)
    lens = np.array([len(w) + (w != END) for w in words], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    owner = np.repeat(np.arange(len(words)), lens)
    pos = np.arange(len(raw)) - start[owner]
    x = raw.astype(np.uint64) + np.uint64(1)
    hashes = [np.minimum(pos, 15).astype(np.uint64)]
    h = np.zeros(len(raw), dtype=np.uint64)
    for k in range(1, 5):
        prev = np.zeros(len(raw), dtype=np.uint64)
        prev[k:] = x[:-k]
        prev[pos < k] = 0
        h = h * np.uint64(0x100000001B3) + prev * np.uint64(ODD)
        hashes.append(h.copy())
    run = np.cumsum(x * _powers(int(pos.max()) + 1 if len(pos) else 1)[pos])
    before = np.concatenate([np.zeros(1, np.uint64), run])[:-1]
    hashes.append(before - before[start[owner]] + pos.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    salt = np.asarray(topic, dtype=np.uint64)[owner] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = [_high(v + np.uint64(k + 1) + (salt if k not in (3, 4) else np.uint64(0))) for k, v in enumerate(hashes)]
    return raw, owner, mixed, _final(hashes[-1] * np.uint64(ODD) + x * np.uint64(0x165667B19E3779F9) + salt)


def _bits(raw, mixed, bits: int):
    """For each of the eight bits: the bits, and the slots of every order."""
    import numpy as np

    node = np.ones(len(raw), dtype=np.uint32)
    for b in range(7, -1, -1):
        bit = ((raw >> b) & 1).astype(np.int32)
        salt = node * np.uint32(0x85EBCA6B)
        yield 7 - b, bit, [_slot(v, salt, bits) for v in mixed]
        node = node * np.uint32(2) + bit.astype(np.uint32)


def _blocks(words: list[bytes], most: int = 1 << 16):
    """Runs of words of about ``most`` bytes in all."""
    at, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(words):
        yield at, len(words)


def count_spelling(words: list[bytes], topic, counts, bits: int):
    """Counts of zeros and ones in every slot, two columns."""
    import numpy as np

    table = np.zeros(2 << bits)
    for a, z in _blocks(words, 1 << 19):
        raw, owner, mixed, same = _contexts(words[a:z], topic[a:z])
        first, index = _groups(same)
        weight = np.bincount(index, weights=np.asarray(counts[a:z], dtype=np.float64)[owner], minlength=len(first))
        for b in range(0, len(first), 1 << 17):
            few = first[b : b + (1 << 17)]
            hit = np.concatenate([s * 2 + bit for _, bit, slots in _bits(raw[few], [v[few] for v in mixed], bits) for s in slots])
            table += np.bincount(hit, weights=np.tile(weight[b : b + (1 << 17)], 8 * SPELL_ORDERS), minlength=2 << bits)
    return table.reshape(-1, 2)


def spell(words: list[bytes], topic, counts, table, mix: Mix, learn: bool = False):
    """log10 of the spelling of each word, one occurrence of those with ``counts`` above 0 taken out."""
    import numpy as np

    out, counts = np.zeros(len(words)), np.asarray(counts, dtype=np.float64)
    bits = (len(table) - 1).bit_length()
    for a, z in _blocks(words, 1 << 14 if learn else 1 << 18):
        raw, owner, mixed, same = _contexts(words[a:z], topic[a:z])
        c = counts[a:z][owner]
        own = c > 0
        first, index = _groups(same ^ own.astype(np.uint64))
        if learn:
            weight = np.bincount(index, weights=np.sqrt(c / max(c.mean(), 1e-9)), minlength=len(first)).astype(np.float32)
            times = np.bincount(index, minlength=len(first)).astype(np.float32)
        cost = np.zeros(len(first))
        for b in range(0, len(first), 1 << 15):
            e = min(b + (1 << 15), len(first))
            few = first[b:e]
            own_ = own[few].astype(np.int32)
            for lane, bit, slots in _bits(raw[few], [v[few] for v in mixed], bits):
                st, gate = evidence(table, slots, bit, own_, 3, 5)
                cost[b:e] += mix.learn(st, gate, lane, bit, weight[b:e], times[b:e]) if learn else mix.cost(st, gate, lane, bit)
        out[a:z] = np.bincount(owner, weights=cost[index], minlength=z - a)
    return out / np.log(10)


def blend_of(bits, in_topic, in_all, topic_total, total: float):
    """Shares of spelling, topic and corpus that fit known words best, each word's own occurrence taken out."""
    import numpy as np

    parts = np.stack([
        10.0 ** bits, np.maximum(in_topic - 1, 0) / np.maximum(topic_total - 1, 1), np.maximum(in_all - 1, 0) / max(total - 1, 1)
    ])
    blend = np.array([0.4, 0.4, 0.2])
    for _ in range(30):
        got = blend[:, None] * parts
        blend = ((got / np.maximum(got.sum(axis=0), 1e-300)) * in_topic).sum(axis=1) / max(in_topic.sum(), 1)
        blend = np.maximum(blend, 1e-3)
        blend /= blend.sum()
    return blend


def blended(blend, bits, in_topic, in_all, topic_total, total: float, own):
    """log10 of the blend of 10^bits and the word's shares, ``own`` occurrences taken out."""
    import numpy as np

    share = blend[1] * np.maximum(in_topic - own, 0) / np.maximum(topic_total - own, 1)
    share = share + blend[2] * np.maximum(in_all - own, 0) / np.maximum(total - own, 1)
    rest = bits * np.log(10) + np.log(blend[0])
    return np.where(share > 0, np.logaddexp(rest, np.log(np.maximum(share, 1e-300))), rest) / np.log(10)


# ---- corpus ------------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (key % FOLDS == HELD).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def _chunks(batches):
    """Bounded chunks of a task's texts: (chunk number, ids, held out as 0 and 1, bytes, tokens)."""
    import numpy as np
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        text = b.column(2)
        off = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        ids, held = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=np.float64)
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
            tokens = Tokens(np.frombuffer(raw[off[at] : off[stop]].tobytes().lower(), dtype=np.uint8), off[at : stop + 1] - off[at])
            # A number that another cut of the texts would not give.
            places = tokens.doc.astype(np.uint64) * np.uint64(2) + np.uint64(1)
            digest = np.concatenate([np.array([part, seq, stop - at], dtype=np.uint64), tokens.hash * places])
            number = int(_sums(digest, np.array([len(digest)]))[0].view(np.int64))
            yield number, ids[at:stop], held[at:stop], np.diff(off[at : stop + 1]), tokens
            at, seq = stop, seq + 1


def _added(parts: DataFrame, dtype: str = "<f8") -> dict:
    """``parts`` (piece int, sums binary) added up by piece, where each blob is a zlib-packed array."""

    def add_up(batches):
        import zlib

        import numpy as np
        import pandas as pd

        acc: dict = {}
        for pdf in batches:
            for i, raw in zip(pdf["piece"], pdf["sums"]):
                acc[i] = acc.get(i, 0) + np.frombuffer(zlib.decompress(raw), dtype=dtype).astype(np.float64)
        for i, x in acc.items():
            yield pd.DataFrame({"piece": [i], "sums": [zlib.compress(x.astype(dtype).tobytes(), 1)]})

    import zlib

    import numpy as np

    found = parts.repartition("piece").mapInPandas(add_up, "piece int, sums binary").collect()
    return {r["piece"]: np.frombuffer(zlib.decompress(r["sums"]), dtype=dtype) for r in found}


def _blobs(arrays):
    """Arrow rows (piece, packed array) for ``_added``."""
    import zlib

    import pyarrow as pa

    for piece, x in arrays:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["piece", "sums"])


BLOB = "piece int, sums binary"


def _frequent(rows: DataFrame) -> list[bytes]:
    """The most frequent training words, by the sums of what each task counts of its own most frequent ones."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts: dict[bytes, int] = {}
        for _, _, held, _, tokens in _chunks(batches):
            use = np.flatnonzero(held[tokens.doc] == 0)
            first, index = _groups(tokens.hash[use])
            n = np.bincount(index, minlength=len(first))
            top = np.argsort(-n, kind="stable")[: 8 * FREQUENT]
            for w, c in zip(tokens.words(use[first[top]]), n[top].tolist()):
                counts[w] = counts.get(w, 0) + c
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 4 * FREQUENT]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([c for _, c in best], pa.int64())], names=["word", "n"])

    found = rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def _survey(rows: DataFrame, words: list[bytes]):
    """Paths by exact counts, topics, and the number of training tokens."""
    import numpy as np

    plain = Paths(words, [1] * len(words), 1)
    width, skip = min(TOPIC_WORDS, max(1, len(words))), words.index(END) if END in words else -1

    def run(batches):
        counts = np.zeros(len(words) + 1)
        sums, many = np.zeros((width, width)), np.zeros(width)
        for _, _, held, _, tokens in _chunks(batches):
            counts += np.bincount(tokens.symbols(plain), weights=1 - held[tokens.doc], minlength=len(counts))
            v = Topics.vectors(tokens, plain, width, skip)
            use = np.flatnonzero((held == 0) & (v.max(axis=1, initial=0) > 0))
            top = v[use].argmax(axis=1)
            np.add.at(sums, top, v[use])
            many += np.bincount(top, minlength=width)
        yield from _blobs([(-1, counts), (-2, many), *((k, sums[k]) for k in np.flatnonzero(many))])

    got = _added(rows.mapInArrow(run, BLOB))
    counts = got.get(-1, np.zeros(len(words) + 1))
    sums = np.zeros((width, width))
    for k, v in got.items():
        if k >= 0:
            sums[k] = v
    return Paths(words, counts[:-1].astype(int).tolist(), int(counts[-1])), Topics(sums, got.get(-2, np.zeros(width)), skip), int(counts.sum())


def _table(parts: DataFrame, bits: int):
    """The states of the table that the pieces add up to."""
    import numpy as np

    out = np.zeros(2 << bits, dtype=np.float32)
    for i, x in _added(parts, "<f4").items():
        out[i * len(x) : (i + 1) * len(x)] = x
    return states(out.reshape(-1, 2))


def _pieces(table):
    import numpy as np

    flat = table.ravel().astype("<f4")
    return _blobs((i, x) for i, x in enumerate(np.split(flat, min(64, len(flat)))) if x.any())


def _few(df: DataFrame) -> DataFrame:
    """Fewer, larger tasks, for the tables that each task sends."""
    return df.coalesce(max(6, df.rdd.getNumPartitions() // 4))


def _learn_paths(rows: DataFrame, paths, topics, bits: int):
    """Path counts of all training tokens, and the mixer learned on them."""
    import numpy as np

    sc = rows.sparkSession.sparkContext

    def count(batches):
        table, hits, many = np.zeros(2 << bits, dtype=np.float32), [], 0
        for _, _, held, _, tokens in _chunks(batches):
            z = topics.value.of(tokens, paths.value)[held == 0]
            for _, _, _, bit, _, slots in decisions(_training(tokens, held), paths.value, z, bits):
                hits += [(s * 2 + bit).astype(np.int32) for s in slots]
                many += len(slots) * len(bit)
                if many > 4 << bits:
                    table += np.bincount(np.concatenate(hits), minlength=2 << bits)
                    hits, many = [], 0
        table += np.bincount(np.concatenate([*hits, np.zeros(0, np.int32)]), minlength=2 << bits)
        yield from _pieces(table)

    table = sc.broadcast(_table(_few(rows).mapInArrow(count, BLOB), bits))

    def learn(batches):
        mix = Mix(PATH_ORDERS)
        for _, _, held, _, tokens in _chunks(batches):
            z = topics.value.of(tokens, paths.value)
            path_costs(_training(tokens, held), paths.value, z[held == 0], table.value, mix, np.zeros(int((held == 0).sum())), learn=True)
        yield from _blobs([(0, mix.state())])

    state = _added(rows.mapInArrow(learn, BLOB))
    return table, Mix(PATH_ORDERS).take(state[0]) if state else Mix(PATH_ORDERS)


def _training(tokens: Tokens, held):
    """The tokens of the texts that are not held out."""
    import copy

    import numpy as np

    out = copy.copy(tokens)
    out._paths = None
    use = held[tokens.doc] == 0
    number = np.cumsum(held == 0) - 1
    out.start, out.size, out.hash, out.doc = tokens.start[use], tokens.size[use], tokens.hash[use], number[tokens.doc[use]]
    out.first = np.searchsorted(out.doc, np.arange(int((held == 0).sum()) + 1))
    return out


def _groups(keys):
    """(a place of each distinct key, the number of the key of each place), by a table of places; what meets another key there
    is sorted."""
    import numpy as np

    n = len(keys)
    slot = (keys >> np.uint64(64 - max(8, min(22, (4 * n).bit_length())))).astype(np.intp)
    table = np.empty(int(slot.max()) + 1 if n else 0, dtype=np.int32)
    table[slot] = np.arange(n, dtype=np.int32)
    place = table[slot]
    own = keys[place] == keys
    mark = np.zeros(n, dtype=bool)
    mark[place[own]] = True
    index = (np.cumsum(mark) - 1)[place]
    rest = np.flatnonzero(~own)
    _, first, number = np.unique(keys[rest], return_index=True, return_inverse=True)
    index[rest] = mark.sum() + number
    return np.concatenate([np.flatnonzero(mark), rest[first]]), index


def _units(tokens: Tokens, paths: Paths, topic):
    """What a chunk looks up: (a token of each distinct rare word, hashes of the distinct runs, topics of the former; places of
    the rare tokens, the index of each; first token, length and index, after those of the words, (-1: too short) of each run)."""
    import numpy as np

    rare = np.flatnonzero(tokens.symbols(paths) == len(paths.words))
    key = tokens.hash[rare] ^ (topic[tokens.doc[rare]].astype(np.uint64) * np.uint64(ODD))
    first, index = _groups(key)
    at, size, run = tokens.runs()
    long = np.flatnonzero(size >= LEAST_RUN)
    names, which = _groups(run[long])
    place = np.full(len(at), -1)
    place[long] = which + len(first)
    where = rare[first]
    return where, run[long][names], topic[tokens.doc[where]], rare, index, at, size, place


def _bytes_of(data, start, size):
    """The bytes of the words that begin at ``start``, one after the other."""
    import numpy as np

    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _cut(x, edges):
    """Arrow binary array of the stretches of an array between neighbouring edges."""
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _joined(column, dtype: str):
    """The array whose stretches are the rows of a binary column."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


#: The distinct rare words of a chunk and topic, and its distinct runs (size 0, topic 0): a row for each bucket of their hashes,
#: every binary column an array. at: index in the chunk, c and n: count in the chunk's training texts and in all.
UNITS = "bucket int, chunk long, hash binary, z binary, at binary, size binary, words binary, c binary, n binary"
#: Distinct units at most in one step, so that Arrow's offsets suffice.
UNITS_MOST = 1 << 21


def _chunk_units(rows: DataFrame, paths, topics, split: int) -> DataFrame:
    """UNITS of all chunks, in 2^split buckets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for number, _, held, _, tokens in _chunks(batches):
            where, runs, z, rare, index, at, _, place = _units(tokens, paths.value, topics.value.of(tokens, paths.value))
            size, ok = len(where) + len(runs), place >= 0
            c = np.bincount(index, weights=1 - held[tokens.doc[rare]], minlength=size)
            c = (c + np.bincount(place[ok], weights=1 - held[tokens.doc[at[ok]]], minlength=size)).astype("<u4")
            n = (np.bincount(index, minlength=size) + np.bincount(place[ok], minlength=size)).astype("<u4")
            z = np.concatenate([z, np.zeros(len(runs), np.int64)]).astype(np.uint8)
            data = np.append(tokens.data, np.uint8(END[0]))  # where the end token lies, if it is a rare word
            start = np.where(tokens.start[where] < 0, len(tokens.data), tokens.start[where]).astype(np.int64)
            start, bytes_ = (np.concatenate([x, np.zeros(len(runs), np.int64)]) for x in (start, tokens.size[where].astype(np.int64)))
            hashes = np.concatenate([tokens.hash[where], runs])
            for a in range(0, size, UNITS_MOST):
                bucket = (hashes[a : a + UNITS_MOST] >> np.uint64(64 - split)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                many = np.bincount(bucket, minlength=1 << split)
                edges = np.concatenate([[0], np.cumsum(many[many > 0])])
                order += a
                length = np.concatenate([[0], np.cumsum(bytes_[order])])[edges]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.flatnonzero(many), pa.int32()), pa.array(np.full(len(edges) - 1, number), pa.int64()), _cut(hashes[order], edges),
                     _cut(z[order], edges), _cut(order.astype("<u4"), edges), _cut(bytes_[order].astype("<u4"), edges),
                     _cut(_bytes_of(data, start[order], bytes_[order]), length), _cut(c[order], edges), _cut(n[order], edges)],
                    names=[x.split()[0] for x in UNITS.split(", ")],
                )

    return rows.mapInArrow(run, UNITS)


#: A row for each bucket, every binary column an array. words, size, c: bytes, size and training count of each distinct rare word;
#: word, z, cz: the word's number, topic and training count there of each pair of a word and a topic that occurs; run, run_c: hash and
#: training count of runs; chunk, many: each chunk and how many units it looks up; at, target: index in the chunk and number of
#: the pair (of the run, after those of the pairs) of each. totals: training count of words, words with one, training count of
#: runs (of those without a row too), training counts by topic.
VOCABULARY = (
    "bucket int, words binary, size binary, c binary, word binary, z binary, cz binary, run binary, run_c binary, chunk binary, "
    "many binary, at binary, target binary, totals binary"
)


def _vocabulary(units: DataFrame, split: int) -> DataFrame:
    """VOCABULARY of the units. Runs that no training text holds, or that occur once in all, are not needed."""

    def gather(t):
        import numpy as np
        import pyarrow as pa

        h, z, at, size, raw, c, n = (
            _joined(t.column(k), d) for k, d in (("hash", "<u8"), ("z", "u1"), ("at", "<u4"), ("size", "<u4"), ("words", "u1"), ("c", "<u4"), ("n", "<u4"))
        )
        h, size, start = h << np.uint64(split), size.astype(np.int64), np.cumsum(size, dtype=np.int64) - size  # the bits above are those of the bucket
        is_word = size > 0
        w, r = np.flatnonzero(is_word), np.flatnonzero(~is_word)
        first, index = _groups(h[w])
        total = np.bincount(index, weights=c[w], minlength=len(first)).astype("<i8")
        pair = index * TOPICS + z[w]
        there = np.zeros(len(first) * TOPICS, dtype=bool)
        there[pair] = True
        number = np.cumsum(there) - 1
        pairs = np.flatnonzero(there)
        cz = np.bincount(number[pair], weights=c[w], minlength=len(pairs)).astype("<i8")
        run_first, run = _groups(h[r])
        run_c, run_n = (np.bincount(run, weights=x[r], minlength=len(run_first)).astype("<i8") for x in (c, n))
        keep = (run_c > 0) & (run_n > 1)
        target = np.zeros(len(h), dtype=np.int64)
        target[w] = number[pair]
        target[r] = np.where(keep, len(pairs) + np.cumsum(keep) - 1, -1)[run]
        use = target >= 0
        of = np.repeat(np.arange(t.num_rows), [len(x) // 8 for x in t.column("hash").to_pylist()])
        names = w[first]
        by_topic = np.bincount(pairs % TOPICS, weights=cz, minlength=TOPICS)
        bucket = t.column("bucket")[0].as_py()
        whole = (h[r[run_first[keep]]] >> np.uint64(split)) | (np.uint64(bucket) << np.uint64(64 - split))
        parts = [
            _bytes_of(raw, start[names], size[names]), size[names].astype("<u4"), total, (pairs // TOPICS).astype("<u4"), (pairs % TOPICS).astype(np.uint8),
            cz, whole, run_c[keep], t.column("chunk").to_numpy().astype("<i8"), np.bincount(of[use], minlength=t.num_rows).astype("<u4"), at[use],
            target[use].astype("<u4"), np.array([total.sum(), (total > 0).sum(), run_c.sum(), *by_topic], dtype="<i8"),
        ]
        return pa.table([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[x.split()[0] for x in VOCABULARY.split(", ")])

    return units.groupBy("bucket").applyInArrow(gather, VOCABULARY)


def _pairs(t, row: int):
    """(words, topic, training count, training count of the word in all topics) of all pairs of a row of VOCABULARY."""
    import numpy as np

    raw, size, c, word, z, cz = (t.column(k)[row].as_py() for k in ("words", "size", "c", "word", "z", "cz"))
    end = np.cumsum(np.frombuffer(size, dtype="<u4"), dtype=np.int64)
    words = [raw[a:e] for a, e in zip([0, *end[:-1].tolist()], end.tolist())]
    word = np.frombuffer(word, dtype="<u4")
    return [words[i] for i in word.tolist()], np.frombuffer(z, dtype="u1").astype(np.int64), np.frombuffer(cz, dtype="<i8"), np.frombuffer(c, dtype="<i8")[word]


def _known(t):
    """The pairs of some rows of VOCABULARY that training texts hold."""
    import numpy as np

    words, rest = [], [[np.zeros(0, np.int64)] * 3]
    for row in range(t.num_rows):
        w, *x = _pairs(t, row)
        use = np.flatnonzero(x[1] > 0)
        words += w if len(use) == len(w) else [w[i] for i in use.tolist()]
        rest.append([k[use] for k in x])
    return words, *(np.concatenate(x) for x in zip(*rest))


def _listed(vocab: DataFrame) -> DataFrame:
    """A row for each word, and for each run as a space and eight bytes: word, c (its count in training tokens; 0 for words of
    held-out texts only), topics (bits), cz (counts by topic)."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        for t in batches:
            for row in range(t.num_rows):
                words, z, cz, c = _pairs(t, row)
                by: dict = {}
                for w, k, n, all_ in zip(words, z.tolist(), cz.tolist(), c.tolist()):
                    x = by.setdefault(w, [all_, 0, [0] * TOPICS])
                    x[1] |= 1 << k
                    x[2][k] = n
                names, counts = (np.frombuffer(t.column(k)[row].as_py(), dtype="<i8") for k in ("run", "run_c"))
                by |= {b" " + h.tobytes(): [n, 1, [0] * TOPICS] for h, n in zip(names, counts.tolist())}
                out = pd.DataFrame([[w, *x] for w, x in by.items()], columns=["word", "c", "topics", "cz"])
                yield pa.RecordBatch.from_pandas(out, pa.schema([("word", pa.binary()), ("c", pa.int64()), ("topics", pa.int32()), ("cz", pa.list_(pa.int64()))]), preserve_index=False)

    return vocab.mapInArrow(run, "word binary, c long, topics int, cz array<long>")


def _learn_spelling(vocab: DataFrame, size: int, total: int, topic_total):
    """Spelling counts of all training words, and mixer and blend learned on all of them in groups of about GROUP."""
    import numpy as np

    sc = vocab.sparkSession.sparkContext
    known = vocab.select("bucket", "words", "size", "c", "word", "z", "cz")
    bits = min(SPELL_BITS, max(12, (64 * size).bit_length()))

    def count(batches):
        table = np.zeros((1 << bits, 2))
        for t in batches:
            words, z, cz, _ = _known(t)
            if words:
                table += count_spelling(words, z, cz, bits)
        yield from _pieces(table)

    table = sc.broadcast(_table(_few(known).mapInArrow(count, BLOB), bits))

    def learn(t):
        import pyarrow as pa

        words, z, cz, c = _known(t)
        order = np.lexsort((z, hash_of(words)))
        words, z, cz, c = [words[i] for i in order.tolist()], z[order], cz[order], c[order]
        mix = Mix(SPELL_ORDERS)
        got = spell(words, z, cz, table.value, mix, learn=True)
        blend = blend_of(got, cz.astype(float), c.astype(float), np.array(topic_total)[z], total) * cz.sum()
        return pa.Table.from_batches(_blobs([(0, np.concatenate([mix.state(), blend, [cz.sum()]]))] if words else []), schema=pa.schema([("piece", pa.int32()), ("sums", pa.binary())]))

    groups = known.withColumn("g", F.pmod("bucket", F.lit(max(1, -(-size // GROUP)))))
    got = _added(groups.groupBy("g").applyInArrow(learn, BLOB))
    if not got:
        return table, Mix(SPELL_ORDERS), np.array([0.4, 0.4, 0.2])
    return table, Mix(SPELL_ORDERS).take(got[0][:-4]), got[0][-4:-1] / max(got[0][-1], 1)


@dataclass
class Learned:
    """What scoring needs of the training texts; the first four and the spelling table are broadcasts."""

    paths: object
    topics: object
    path_table: object
    spell_table: object
    path_mix: Mix
    spell_mix: Mix
    blend: object
    #: VOCABULARY, and its words and runs row by row.
    packed: DataFrame
    vocab: DataFrame
    #: Training tokens, their distinct words, rare tokens, these by topic, and runs.
    n: int
    v: int
    rare: int
    by_topic: list
    runs: int


def learn(rows: DataFrame) -> Learned:
    import numpy as np

    sc = rows.sparkSession.sparkContext
    paths, topics, n = _survey(rows, _frequent(rows))
    paths, topics = sc.broadcast(paths), sc.broadcast(topics)
    bits = min(PATH_BITS, max(12, (8 * n).bit_length()))
    path_table, path_mix = _learn_paths(rows, paths, topics, bits)
    split = min(BUCKET_BITS[1], max(BUCKET_BITS[0], (n >> 17).bit_length()))
    vocab = stored(_vocabulary(_chunk_units(rows, paths, topics, split), split))
    totals = sum((np.frombuffer(r["totals"], dtype="<i8") for r in vocab.select("totals").collect()), np.zeros(3 + TOPICS, np.int64))
    rare, rare_v, runs, *by_topic = totals.tolist()
    v = rare_v + int((paths.value.counts[:-1] > 0).sum())
    spell_table, spell_mix, blend = _learn_spelling(vocab, rare_v, rare, by_topic)
    return Learned(paths, topics, path_table, spell_table, path_mix, spell_mix, blend, vocab, _listed(vocab), n, v, rare, by_topic, runs)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (of the text, and one for its end),
    bits_per_byte."""
    rows = _rows(docs)
    m = learn(rows)
    paths, topics, path_table, spell_table, path_mix, spell_mix = m.paths, m.topics, m.path_table, m.spell_table, m.path_mix, m.spell_mix
    blend, n, v, rare, by_topic, runs = m.blend, m.n, m.v, m.rare, m.by_topic, m.runs

    def cost(batches):
        """For each bucket and chunk: index in the chunk and training count of its units, log10 of each word as it stands, and less an
        own occurrence."""
        import numpy as np
        import pyarrow as pa

        for t in batches:
            for row in range(t.num_rows):
                words, z, cz, c = _pairs(t, row)
                run_c, chunk, many, at, target = (
                    np.frombuffer(t.column(k)[row].as_py(), dtype=d) for k, d in (("run_c", "<i8"), ("chunk", "<i8"), ("many", "<u4"), ("at", "<u4"), ("target", "<u4"))
                )
                bits, total = spell(words, z, cz, spell_table.value, spell_mix), np.array(by_topic, dtype=np.float64)[z]
                unit = [np.concatenate([blended(blend, bits, cz, c, total, rare, own), np.zeros(len(run_c))]).astype("<f4")[target] for own in (0, 1)]
                edges = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk, pa.int64()), _cut(at, edges), _cut(np.concatenate([c, run_c])[target], edges), *(_cut(x, edges) for x in unit)],
                    names=["chunk", "at", "c", "unit", "unit_less"],
                )

    def chunk_docs(batches):
        import numpy as np
        import pyarrow as pa

        for number, ids, held, n_bytes, tokens in _chunks(batches):
            z = topics.value.of(tokens, paths.value)
            *_, rare_at, index, at, size, place = _units(tokens, paths.value, z)
            path = path_costs(tokens, paths.value, z, path_table.value, path_mix, held)
            symbol = tokens.symbols(paths.value)
            common = symbol < len(paths.value.words)
            base = np.where(common, np.log10(paths.value.counts[symbol] + 1.0), 0)
            of = np.repeat(np.arange(len(at)), size)
            run_path = np.bincount(of, weights=path, minlength=len(at)).astype("<f4")
            run_rare = np.bincount(of[rare_at], minlength=len(at)).astype("<i4")
            run_doc = np.searchsorted(tokens.doc[at], np.arange(len(ids) + 1))
            rare_doc = np.searchsorted(tokens.doc[rare_at], np.arange(len(ids) + 1))
            n_tokens = np.diff(tokens.first)
            n_common = np.bincount(tokens.doc, weights=common, minlength=len(ids)).astype(np.int64)
            base = np.bincount(tokens.doc, weights=base, minlength=len(ids))
            place = place + 1  # 0: a run that is too short
            halves = lambda x: [(x & 0xFFFF).astype("<u2"), (x >> 16).astype("<u2")]  # noqa: E731  which compress better apart
            rare_cols, run_cols = halves(index), [*halves(place), *halves(run_rare), run_path]
            for a in range(0, len(ids), 1000):
                e = min(a + 1000, len(ids))
                cut = lambda x, edges: _cut(x[edges[a] : edges[e]], edges[a : e + 1] - edges[a])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(e - a, number), pa.int64()), pa.array(z[a:e], pa.int32()), pa.array(ids[a:e], pa.int64()),
                     pa.array(held[a:e] > 0, pa.bool_()), pa.array(n_tokens[a:e], pa.int64()), pa.array(n_common[a:e], pa.int64()),
                     pa.array(base[a:e], pa.float64()), pa.array(n_bytes[a:e] + 1, pa.int64()),
                     *(cut(x, rare_doc) for x in rare_cols), *(cut(x, run_doc) for x in run_cols)],
                    names=names,
                )

    schema = (
        "chunk long, z int, doc_id long, held_out boolean, n_tokens long, n_common long, common double, n_bytes long, "
        "rare binary, rare_high binary, run binary, run_high binary, many binary, many_high binary, path binary"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    texts = rows.mapInArrow(chunk_docs, schema)
    asked = m.packed.select("words", "size", "c", "word", "z", "cz", "run_c", "chunk", "many", "at", "target")
    priced = asked.mapInArrow(cost, "chunk long, at binary, c binary, unit binary, unit_less binary")

    def sums(prices, docs):
        import numpy as np
        import pyarrow as pa

        if not docs.num_rows:
            raise RuntimeError("the scans of the texts do not agree; score a table or a checkpoint")
        whole = lambda k: _joined(docs.column(k), "<u2").astype(np.int64) + (_joined(docs.column(f"{k}_high"), "<u2").astype(np.int64) << 16)
        rare_of, run_of = (np.repeat(np.arange(docs.num_rows), [len(x) // 2 for x in docs.column(k).to_pylist()]) for k in ("rare", "run"))
        idx, run, many, path = whole("rare"), whole("run") - 1, whole("many"), _joined(docs.column("path"), "<f4")
        at = _joined(prices.column("at"), "<u4").astype(np.int64)
        need = int(idx.max(initial=-1)) + 1
        seen = np.zeros(max(need, int(run.max(initial=-1)) + 1, int(at.max(initial=-1)) + 1), dtype=bool)
        seen[at] = True
        if not seen[:need].all():
            raise RuntimeError("the scans of the texts do not agree; score a table or a checkpoint")
        c = np.zeros(len(seen))
        unit = np.zeros((2, len(seen)))  # log10 of each word as it stands, and less an own occurrence
        c[at] = _joined(prices.column("c"), "<i8")
        for x, k in zip(unit, ("unit", "unit_less")):
            x[at] = _joined(prices.column(k), "<f4")
        z, n_tokens, n_common, common, n_bytes = (docs.column(k).to_numpy() for k in ("z", "n_tokens", "n_common", "common", "n_bytes"))
        own = 1 - docs.column("held_out").to_numpy().astype(np.int64)
        plain = path + np.bincount(np.repeat(np.arange(len(run)), many), weights=unit[own[rare_of], idx], minlength=len(run))
        score = run_costs(plain, run, run_of, c, runs, own) + topics.value.cost[z]
        base = common + np.bincount(rare_of, weights=np.log10(c + 1)[idx], minlength=len(own)) - n_tokens * math.log10(n + v + 1.0)
        n_known = n_common + np.bincount(rare_of, weights=c[idx] > 0, minlength=len(own)).astype(np.int64)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(own), n),
            "base_score": base, "score": score, "n_bytes": n_bytes, "bits_per_byte": -score * 3.3219280948873626 / n_bytes,
        })

    return priced.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(sums, SCHEMA)


def run_costs(plain, run, doc, count, total: int, own):
    """log10 of each text, from that of each run (``plain``; ``doc``: its text, in order): a run that training texts hold, or that
    came before in its text, is named instead where that costs less. The flag's counts adapt along the text. ``own``: 1 for
    each text whose occurrences are to be taken out."""
    import numpy as np

    long = np.flatnonzero(run >= 0)
    known = np.zeros(len(run))
    _, inverse, times = np.unique(doc[long] * (int(run.max(initial=0)) + 1) + run[long], return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    rank = np.empty(len(long))
    rank[order] = np.arange(len(long)) - np.repeat(np.cumsum(times) - times, times)
    known[long] = count[run[long]] - own[doc[long]] * times[inverse] + rank
    first = np.searchsorted(doc, np.arange(len(own) + 1))
    # Texts without a run to name: all flags are those of spelled runs.
    a, b = FLAGS[0]
    steps = np.arange(int(np.diff(first).max(initial=0)))
    flags = np.concatenate([[0.0], np.cumsum(np.log10((a + steps) / (a + b + steps)))])
    out = np.bincount(doc, weights=plain, minlength=len(own)) + flags[np.diff(first)]
    for i in np.unique(doc[known > 0]).tolist():
        flags, last, s = [list(x) for x in FLAGS], 0, 0.0
        for x, k in zip(plain[first[i] : first[i + 1]].tolist(), known[first[i] : first[i + 1]].tolist()):
            a, b = flags[last]
            spelled, named = x + math.log10(a / (a + b)), math.log10(min(1.0, k / (total + 1.0)) * b / (a + b)) if k > 0 else -math.inf
            pick = int(named > spelled)
            s += named if pick else spelled
            flags[last][pick] += 1
            last = pick
        out[i] = s
    return out


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_bytes long, bits_per_byte double"
)


def op1_query(spark, sf_dir) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
