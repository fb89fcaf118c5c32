"""Operator 5: chroma audio fingerprints.

A recording is cut into overlapping frames whose spectra are folded to twelve
pitch classes. Filters that compare areas of the time-by-pitch picture (read
from an integral image) give two bits each; sixteen of them pack into one
32-bit integer a frame. Two recordings align if at some offset the share of
differing bits over the whole overlap is small enough; the overlap must be half of the
shorter one at least, since over a few frames unlike recordings come that near by chance
(of pairs of unlike recordings of the sample tables, 0.2 % do over 32 of 110 frames, none
over 55). At such a share no integer need be equal, so that no key would find all of them: the differing
bits of a query at every offset are counted for every recording, as a
correlation of the bits (by FFT), and the counts decide.

Recordings with equal fingerprints form a class and are compared once. The
query set (ids divisible by 100) is stated; it is compared with every class,
block by block, so that a task holds one block of each side at most. The work
grows with queries times classes.

Edge cases: null or too short payloads have an empty fingerprint, are members
of class -1 and match nothing; null samples count as silence; null ids are
skipped as queries and kept as members; a class is named by its smallest id, and by none
(null) if no member has one; repeated rows are members each; recordings of any length
are compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

RATE, FRAME, HOP = 4096, 1024, 256
LOW_HZ, HIGH_HZ = 100.0, 1900.0
#: Frames that a filter looks at.
WIDTH = 16
MIN_OVERLAP, MIN_SHARE, MAX_BER = 32, 0.5, 0.25
EVERY = 100
#: Stands for the missing name of a class inside the search.
UNNAMED = -(1 << 63)
#: Queries and classes in a block.
QUERY_BLOCK, CLASS_BLOCK = 512, 1024


def _filters():
    """Sixteen filters by rule: kind, first pitch class, pitch classes, frames. Kinds: halves of pitch,
    halves of time, checkers, middle against sides of pitch, of time."""
    return [(i % 5, (5 * i) % 12 % (13 - h), h, w) for i in range(16) for h, w in [((4, 6, 12, 8)[i % 4], (4, 8, 16)[i % 3])]]


@functools.cache
def _folding(rate: int):
    """Window, bins in use and the pitch class of each."""
    import numpy as np

    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    return np.hanning(FRAME).astype(np.float32), slice(use[0], use[-1] + 1), fold


def chroma(samples, rate: int = RATE):
    """Frames by 12 pitch classes, each row of unit length (or zero)."""
    import numpy as np

    if len(samples) < FRAME:
        return np.zeros((0, 12))
    n = 1 + (len(samples) - FRAME) // HOP
    hann, use, fold = _folding(rate)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, dtype=np.float32), FRAME)[::HOP][:n]
    spectrum = np.fft.rfft(frames * hann, axis=1)[:, use]  # single precision
    out = (spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ fold
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0)


def pack(picture):
    """One unsigned 32-bit integer for each frame from which WIDTH frames follow."""
    import numpy as np

    n = len(picture) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(picture) + 1, 13))
    image[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in _filters():
        a, b = h // 2, w // 2
        if kind == 0:
            p, q = area(0, w, y + a, y + h), area(0, w, y, y + a)
        elif kind == 1:
            p, q = area(b, w, y, y + h), area(0, b, y, y + h)
        elif kind == 2:
            p = area(0, b, y + a, y + h) + area(b, w, y, y + a)
            q = area(0, b, y, y + a) + area(b, w, y + a, y + h)
        elif kind == 3:
            c = max(1, h // 3)
            p, q = area(0, w, y + c, y + h - c), area(0, w, y, y + c) + area(0, w, y + h - c, y + h)
        else:
            c = max(1, w // 3)
            p, q = area(c, w - c, y, y + h), area(0, c, y, y + h) + area(w - c, w, y, y + h)
        x = np.log1p(np.maximum(p, 0)) - np.log1p(np.maximum(q, 0))
        level = np.digitize(x, (-0.25, 0.0, 0.25))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbours differ in one bit
    return out


def pcm(payload):
    """Decode 16-bit little-endian PCM."""
    import numpy as np

    return np.frombuffer(payload, dtype="<i2").astype(np.float64) / 32768


def notes(values):
    """Render numbers as notes of 512 samples: the value picks one of 24 semitones over 220 Hz.

    The tables hold no audio; a vector's elements stand for a melody.
    """
    import numpy as np

    v = np.nan_to_num(np.array([0.0 if x is None else x for x in values], dtype=np.float64))
    pitch = np.clip(np.floor((v + 0.6) * 20), 0, 23)
    hz = np.repeat(220.0 * 2 ** (pitch / 12), 512)
    return np.sin(np.cumsum(2 * np.pi * hz / RATE))


def fingerprints(df: DataFrame, key: str, payload: str, decode=pcm) -> DataFrame:
    """id, fp (packed integers), class (128-bit hash of them) for every row."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                fps = []
                for x in part.column(1).to_pylist():
                    fps.append(pack(chroma(decode(x))) if x is not None and len(x) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[int(v) for v in x] for x in fps], pa.list_(pa.int64())),
                     pa.array([xxh3_128_digest(bytes(memoryview(x))) if len(x) else b"" for x in fps], pa.binary())],
                    names=["id", "fp", "class"],
                )

    return df.select(F.col(key).cast("long").alias("id"), F.col(payload)).mapInArrow(run, "id long, fp array<long>, class binary")


def least_overlap(a, b):
    """Fewest frames over which two recordings of these lengths may align."""
    import numpy as np

    return np.maximum(MIN_OVERLAP, np.ceil(MIN_SHARE * np.minimum(a, b)))


def _spectra(fps, size: int):
    """Frequencies by 32 bits by recordings, of the bits as -1 and 1."""
    import numpy as np

    signs = np.zeros((len(fps), 32, size), dtype=np.float32 if size <= 4096 else np.float64)
    for i, x in enumerate(fps):
        signs[i, :, : len(x)] = 2.0 * ((x[None, :] >> np.arange(32, dtype=np.uint32)[:, None]) & np.uint32(1)) - 1
    return np.fft.rfft(signs, axis=2).transpose(2, 1, 0)


def alignments(asked: list, others: list):
    """(i, j, offset, votes, bit error) of every pair that aligns, at the offset with the most agreeing less differing
    bits (ties: the one nearest to 0, then the smaller). ``votes`` are the equal integers at it."""
    import numpy as np

    def by_size(fps):
        sizes: dict[int, list[int]] = {}
        for i, x in enumerate(fps):
            if len(x) >= MIN_OVERLAP:
                sizes.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
        return sizes

    for sq, qs in by_size(asked).items():
        for sr, rs in by_size(others).items():
            size = sq + sr
            shift = np.arange(size)
            shift[shift >= sr] -= size
            many = max(1, (1 << 22) // (32 * size))
            few = max(1, (1 << 23) // (many * size))
            for at in range(0, len(rs), many):
                js = rs[at : at + many]
                right = _spectra([others[j] for j in js], size)
                for start in range(0, len(qs), few):
                    own = qs[start : start + few]
                    left = _spectra([asked[i] for i in own], size).conj().transpose(0, 2, 1)
                    # Agreeing less differing bits, for each offset, query and class.
                    agree = np.fft.irfft(left @ right, size, axis=0)
                    nq, nr = np.unique([len(asked[i]) for i in own]), np.unique([len(others[j]) for j in js])
                    lq = nq if len(nq) == 1 else np.array([len(asked[i]) for i in own])
                    lr = nr if len(nr) == 1 else np.array([len(others[j]) for j in js])
                    s = shift[:, None, None]
                    n = np.minimum(lq[None, :, None], lr[None, None, :] - s) - np.maximum(0, -s)
                    least = np.where(n >= least_overlap(lq[None, :, None], lr[None, None, :]), 32 * n * (1 - 2 * MAX_BER) - 0.5, np.inf).astype(agree.dtype)
                    for x, y in np.argwhere((agree >= least).any(axis=0)).tolist():
                        a, b = asked[own[x]], others[js[y]]
                        best = None
                        line = least[:, min(x, least.shape[1] - 1), min(y, least.shape[2] - 1)]
                        for k in shift[agree[:, x, y] >= line].tolist():
                            m = min(len(a), len(b) - k) - max(0, -k)
                            p, q = a[max(0, -k) :][:m], b[max(0, k) :][:m]
                            wrong = int(np.bitwise_count(p ^ q).sum())
                            if wrong <= MAX_BER * 32 * m:
                                found = (32 * m - 2 * wrong, -abs(k), -k, int((p == q).sum()), wrong / (32.0 * m))
                                best = found if best is None else max(best, found)
                        if best:
                            yield own[x], js[y], -best[2], best[3], best[4]


def align(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """kind 'member': id, class_id of every row. kind 'match': class_id of a query's class (id: the query with the
    smallest id in it), other_class, frame_offset, votes, bit_error of each class aligned with it (itself included)."""
    rows = durable(rows)
    classes = durable(
        rows.where("class <> X''").groupBy("class").agg(
            F.min("id").alias("class_id"),
            F.first("fp").alias("fp"),
            F.min(F.when(F.col("id") % every == 0, F.col("id"))).alias("query"),
        )
    )
    n = classes.agg(F.count("query").alias("queries"), F.count(F.lit(1)).alias("classes")).first()
    q_blocks, c_blocks = (max(1, -(-x // y)) for x, y in ((n["queries"], QUERY_BLOCK), (n["classes"], CLASS_BLOCK)))

    def dealt(df, name, blocks, other, others):
        return df.withColumn(name, F.pmod(F.xxhash64("class"), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        )

    # New names on one side, as a cogroup of two sides with the same attributes loses columns.
    asked = dealt(classes.where("query is not null"), "qb", q_blocks, "cb", c_blocks).select(
        F.col("class_id").alias("qc"), F.col("query").alias("q"), F.col("fp").alias("qfp"), "qb", "cb"
    )
    index = dealt(classes, "cb", c_blocks, "qb", q_blocks).select(F.coalesce("class_id", F.lit(UNNAMED)).alias("class_id"), "fp", "cb", "qb")

    def scan(left, right):
        import numpy as np
        import pandas as pd

        # A side without rows has no columns.
        a, b = (
            [np.asarray(x, dtype=np.int64).astype(np.uint32) for x in pdf[name]] if len(pdf) else []
            for pdf, name in ((left, "qfp"), (right, "fp"))
        )
        out = [
            (left["q"].iat[i], left["qc"].iat[i], right["class_id"].iat[j], *rest) for i, j, *rest in alignments(a, b)
        ]
        return pd.DataFrame(out, columns=["query", "qc", "class_id", "frame_offset", "votes", "bit_error"]).astype(
            {"query": "int64", "qc": "int64", "class_id": "int64", "frame_offset": "int32", "votes": "int64", "bit_error": "float64"}
        )

    found = (
        asked.groupBy("qb", "cb")
        .cogroup(index.groupBy("qb", "cb"))
        .applyInPandas(scan, "query long, qc long, class_id long, frame_offset int, votes long, bit_error double")
    )
    none = lambda kind: F.lit(None).cast(kind)
    named = F.when(F.col("class") == F.lit(b""), F.lit(-1).cast("long")).otherwise(F.col("class_id"))
    members = rows.join(classes.select("class", "class_id"), "class", "left").select(
        F.lit("member").alias("kind"), "id", named.alias("class_id"), none("long").alias("other_class"),
        none("int").alias("frame_offset"), none("long").alias("votes"), none("double").alias("bit_error"),
    )
    return members.unionByName(
        found.select(
            F.lit("match").alias("kind"), F.col("query").alias("id"), F.col("qc").alias("class_id"),
            F.nullif("class_id", F.lit(UNNAMED)).alias("other_class"), "frame_offset", "votes", "bit_error",
        )
    )


def op5_query(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return align(fingerprints(rows, "vec_id", "embedding", decode=notes))
