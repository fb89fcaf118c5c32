"""Operator 9: ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is 0 if it is toxic, else 1 + quality: 0, 1 or 2. One
score f(x) = w.x is shared by all thresholds t1 < t2, with
P(grade >= k) = sigmoid(f(x) - t_k). x holds hashed words and word beginnings
(present or not), kept only where the sample shows that they tell grades apart, and six shape
features of the whole text. The fit takes a bounded sample of labelled rows
(MAX_FIT, the smallest hashes of doc_id); scoring reads every text whole.

Edge cases: null and empty texts have no words and neutral shape, and are
scored like any other; texts of any length are read whole; labels that are null are not
fitted on; of several labels of one document the lowest grade counts, and of several
rows with a labelled doc_id one is fitted on; rows with null or repeated ids are rated
each by its text; without labels
every row keeps a probability just over one half of the top grade; a grade that the sample
lacks gets a smoothed threshold; extra columns pass through ``keep_good``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_FIT = 8_000
GRADES = 3
#: Least documents with a hashed word, and least z of its share in top against lower grades.
MIN_DF, MIN_Z = 5, 5.0
#: Letters of the word beginnings that are features beside whole words: compounds share them.
PREFIXES = (4, 5)
STEPS, RATE, RIDGE = 800, 0.1, 1e-5
KEEP_TAIL = 0.5
SHAPES = 6
FIND = re.compile(r"[^\W_]+").findall


def features(text) -> tuple[list[int], list[float]]:
    """Hashed distinct words and beginnings, and shape: capitals, symbols, bars, repeats, digits, longest word run."""
    from xxhash import xxh32_intdigest

    if not text:
        return [], [0.0] * SHAPES
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, m = len(raw), max(1, len(words))
    left = lambda keep: n - len(raw.translate(None, keep))
    same = sum(a == b for a, b in zip(words, words[1:]))
    shape = [
        left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        left(b"%&$*#!<>{}[]=~^") / n,
        left(b"|") / m,
        same / m,
        left(b"0123456789") / n,
        1 - len(set(words)) / m if m >= 50 else 0.0,
    ]
    plain = {w for t in set(words) for w in FIND(t.decode("utf-8", "replace").lower())}
    stems = {w[:n] for w in plain for n in PREFIXES if len(w) > n}
    return [xxh32_intdigest(w) for w in plain] + [xxh32_intdigest(w, 1) for w in stems], shape


class Model:
    """Weights of hashed words (sorted keys), of cubed-root shapes, and ordered thresholds."""

    def __init__(self, keys, weights, shape_weights, mean, thresholds):
        self.weights = dict(zip(keys, weights))
        self.shape_weights, self.mean, self.thresholds = shape_weights, mean, thresholds

    def score(self, text) -> tuple[float, list[float]]:
        hashed, shape = features(text)
        get = self.weights.get
        f = sum(get(h, 0.0) for h in hashed)
        if text:
            f += sum(w * (x ** (1 / 3) - m) for w, x, m in zip(self.shape_weights, shape, self.mean))
        return f, [1 / (1 + math.exp(min(60, max(-60, t - f)))) for t in self.thresholds]


def telling(df, grades):
    """Which features tell grades apart. ``df``: documents with each feature, a column for each grade; ``grades``: documents of each.

    At every threshold the shares above and below it are compared, so that words of the lowest grade alone count too.
    """
    import numpy as np

    total, n = df.sum(axis=1), grades.sum()
    share = total / max(n, 1)
    keep = np.zeros(len(df), dtype=bool)
    for k in range(1, GRADES):
        low, high = max(1, grades[:k].sum()), max(1, grades[k:].sum())
        z = (df[:, k:].sum(axis=1) / high - df[:, :k].sum(axis=1) / low) / np.sqrt(share * (1 - share) * (1 / high + 1 / low) + 1e-12)
        keep |= np.abs(z) >= MIN_Z
    return keep & (total >= MIN_DF)


def fit(row, key, shapes, grade) -> Model:
    """Full-batch gradient descent (Adam) on the cumulative-link likelihood.

    ``row``, ``key``: a row's number and a hashed feature that it has, once for each of its features that are in the model.
    """
    import numpy as np

    rows = range(len(grade))
    if not len(grade):
        return Model([], [], [0.0] * SHAPES, [0.0] * SHAPES, [-2.0, -0.01])
    top = grade == GRADES - 1
    keys, col = np.unique(key, return_inverse=True)
    shapes = np.cbrt(shapes)
    mean = shapes[top].mean(axis=0) if top.any() else shapes.mean(axis=0)
    shapes = shapes - mean
    weight = np.full(len(rows), 1 / len(rows))
    w, v = np.zeros(len(keys)), np.zeros(SHAPES)
    t = np.array([-2.0, 0.0])
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, t)]
    for step in range(1, STEPS + 1):
        f = np.bincount(row, weights=w[col], minlength=len(rows)) + shapes @ v
        tail = [np.ones(len(rows)), sig(f - t[0]), sig(f - t[1]), np.zeros(len(rows))]
        up, down = np.choose(grade, tail[:3]), np.choose(grade, tail[1:])
        p = np.maximum(up - down, 1e-9)
        slope = [x * (1 - x) for x in tail]
        su, sd = np.choose(grade, slope[:3]), np.choose(grade, slope[1:])
        g = -(su - sd) / p * weight
        gt = np.array([
            (weight * ((grade == k + 1) * slope[k + 1] - (grade == k) * slope[k + 1]) / p).sum() for k in range(GRADES - 1)
        ])
        grads = (np.bincount(col, weights=g[row], minlength=len(keys)) + RIDGE * w, shapes.T @ g + RIDGE * v, gt + RIDGE * t)
        for x, d, (m1, m2) in zip((w, v, t), grads, state):
            m1 *= 0.9
            m1 += 0.1 * d
            m2 *= 0.99
            m2 += 0.01 * d * d
            x -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        t[0] = min(t[0], t[1] - 0.05)
    return Model(keys.tolist(), w.tolist(), v.tolist(), mean.tolist(), t.tolist())


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Fit on at most ``max_fit`` labelled documents.

    Features are counted and chosen by Spark; the driver gets the counts of those that MIN_DF documents have,
    and for each document only the chosen ones that it has. Of several rows with a labelled doc_id the one with the least
    hash of its text is taken.
    """
    import numpy as np

    graded = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("toxic") > 0, 0).otherwise(1 + F.col("quality"))).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_fit)
        .select(F.col("doc_id").alias("__pl_id"), F.least(F.greatest("grade", F.lit(0)), F.lit(GRADES - 1)).alias("__pl_g"))
    )
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")).join(F.broadcast(graded), F.col("doc_id") == F.col("__pl_id"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [features(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([x[0] for x in got], pa.list_(pa.int64())), pa.array([x[1] for x in got], pa.list_(pa.float64()))],
                names=["doc_id", "g", "th", "h", "s"],
            )

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__pl_g").alias("g"), "th", "text").mapInArrow(
        run, "doc_id long, g int, th long, h array<long>, s array<double>"
    )
    found = stored(found.groupBy("doc_id").agg(F.min_by(F.struct("g", "h", "s"), "th").alias("x")).select("doc_id", "x.*"))
    flat = found.select("doc_id", "g", F.explode("h").alias("h"))
    counts = [F.count_if(F.col("g") == k).alias(f"n{k}") for k in range(GRADES)]
    head = found.select("doc_id", "g", "s").toArrow().sort_by("doc_id").combine_chunks()
    grade = head.column("g").to_numpy()
    table = flat.groupBy("h").agg(*counts).where(sum((F.col(f"n{k}") for k in range(1, GRADES)), F.col("n0")) >= MIN_DF).toArrow().sort_by("h")
    df = np.stack([table.column(f"n{k}").to_numpy() for k in range(GRADES)], axis=1).astype(float)
    chosen = table.column("h").to_numpy()[telling(df, np.bincount(grade, minlength=GRADES))] if len(grade) else np.zeros(0, np.int64)
    shared = docs.sparkSession.createDataFrame([(int(x),) for x in chosen], "h long")
    some = flat.join(F.broadcast(shared), "h", "left_semi").select("doc_id", "h").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    row = np.searchsorted(head.column("doc_id").to_numpy(), some.column("doc_id").to_numpy())
    shapes = head.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES)
    return fit(row, some.column("h").to_numpy(), shapes, grade)


def rate(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail (probability of the top grade), keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [shared.value.score(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sum(p) for p in got], pa.float64()), pa.array([p[-1] for p in got], pa.float64()),
                 pa.array([p[-1] >= keep_tail for p in got], pa.bool_())],
                names=["doc_id", "expected_grade", "tail", "keep"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail double, keep boolean")


def keep_good(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of ``docs`` whose probability of the top grade is ``keep_tail`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t)[1][-1] >= keep_tail for t in texts], dtype=bool)

    return docs.where(good(F.col("text").cast("string")))


def op9_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rate(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
