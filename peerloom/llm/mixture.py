"""Operator 2: mixing sources to target weights by hierarchical budgeting.

A token budget runs down a weight tree (domain, language, source). At each
node the children share it by weight; a child that cannot use its share takes
what it has, and the shortage goes to its siblings first. Only what all of
them together cannot use returns to the parent's level. A leaf then takes
whole epochs and, of the next epoch's seeded order, the longest prefix whose
tokens fit the rest of its budget.

A row's place in the order is a hash of its doc_id, its text and the epoch. Rows
that are equal in both share a place and are taken together. No row is found by
its id: each is compared with the last place that its leaf takes, so that texts
are never shuffled.

Edge cases: null levels are the child named ""; null text has no tokens; null
and repeated doc_ids are rows of their own, told apart by their texts; weights
of zero select nothing, and their children's tokens count for nobody; an empty
table gives no rows; extra columns pass through ``mix``, and those named as a level
or as ``domain`` stay the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, with_running_sum

LEVELS = ["domain", "lang", "source"]
#: Weight of a child by its name within its level; "*" stands for all others.
WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "*": 1.0},
    "lang": {"en": 5.0, "fr": 2.0, "de": 2.0, "*": 1.0},
    "source": {"*": 1.0},
}
#: Budget as a share of all tokens, and the most epochs that a leaf may be repeated.
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.8, 3, 20
#: A plan whose names hold no more bytes is broadcast; a larger one is joined by the sizes that Spark sees.
BROADCAST_BYTES = 16 << 20


def share_out(budget: int, children: list[tuple[str, float, int]]) -> dict[str, int]:
    """Split ``budget`` over (name, weight, capacity) by weight; shortages go to the siblings left."""
    left, out = budget, {c[0]: 0 for c in children}
    todo = sorted((c for c in children if c[1] > 0 and c[2] > 0), key=lambda c: (c[2] / c[1], c[0]))
    total, k = sum(c[1] for c in todo), 0
    while k < len(todo) and todo[k][2] * total <= left * todo[k][1]:  # the least of capacity by weight is full first
        name, w, cap = todo[k]
        out[name] = cap
        left, total, k = left - cap, total - w, k + 1
    at, taken, rest = 0.0, 0, sorted(todo[k:])
    total = sum(c[1] for c in rest)
    for name, w, _ in rest:  # cumulative rounding: the parts add up to what is left
        at += w
        upto = round(left * at / total)
        out[name], taken = upto - taken, upto
    return out


def _sharing(path: list[str]):
    """The children (w, cap) of one node, whose budget is ``above``, with their budgets."""

    def share(pdf):
        parts = share_out(int(pdf["above"].iat[0]), list(zip(pdf[path[-1]], pdf["w"], pdf["cap"].astype(int))))
        return pdf[path].assign(budget=[parts[x] for x in pdf[path[-1]]]).astype({"budget": "int64"})

    return share


def plan_budget(leaves: DataFrame, budget: int, weights: dict, names: list[str], levels: list[str], epochs: int) -> DataFrame:
    """``leaves`` (the ``names`` of each path, ``tokens``) with ``budget``: the tokens that each leaf gives.

    Capacities add up from the leaves, without children of weight zero; budgets run down, the
    children of one node in one task. Nothing is collected, so that any number of leaves will do.
    """
    weight = []
    for level, n in zip(levels, names):
        other = float(weights[level].get("*", 0.0))
        own = [F.lit(x) for name, w in weights[level].items() if name != "*" for x in (name, float(w))]
        weight.append(F.coalesce(F.element_at(F.create_map(*own), F.col(n)), F.lit(other)) if own else F.lit(other))
    usable = F.when(F.least(*weight, F.lit(1.0)) > 0, F.col("tokens") * epochs).otherwise(0).cast("long")
    tree = leaves.withColumn("cap", usable).select("*", *[w.alias(f"__pl_w{k}") for k, w in enumerate(weight)])
    given = None
    for k in range(len(names)):
        path = names[: k + 1]
        level = tree.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"__pl_w{k}").alias("w"))
        level = level.crossJoin(leaves.sparkSession.range(1).select(F.lit(budget).cast("long").alias("above"))) if given is None else level.join(given, names[:k])
        kinds = ", ".join(f"{n} string" for n in path) + ", budget long"
        # The least of a node's capacity and budget is what it can give, so nothing is lost further down.
        given = level.groupBy(*names[:k]).applyInPandas(_sharing(path), kinds).withColumnRenamed("budget", "above")
    return leaves.join(given.withColumnRenamed("above", "budget"), names)


def _planned(docs: DataFrame, weights: dict, levels: list[str], budget_share: float, epochs: int, seed: int):
    """(names of the level columns; narrow rows: doc_id, names, __pl_n (tokens), __pl_t (hash of the text); the plan:
    names, __pl_budget, __pl_full (whole epochs), __pl_last (the last place taken in the next one))."""
    names = [f"__pl_l{i}" for i in range(len(levels))]
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = durable(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_named(levels, names), tokens.alias("__pl_n"), _hash().alias("__pl_t"))
    )
    leaves = durable(rows.groupBy(*names).agg(F.sum("__pl_n").alias("tokens")))
    size = leaves.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(sum((F.octet_length(n) for n in names), F.lit(64))), F.lit(0)).alias("bytes"),
    ).first()
    plan = plan_budget(leaves, int(budget_share * size["tokens"]), weights, names, levels, epochs)
    plan = durable(
        plan.select(*names, F.col("budget").alias("__pl_budget"), F.expr("budget div greatest(tokens, 1)").alias("__pl_full"),
                    F.expr("budget % greatest(tokens, 1)").alias("__pl_rest"))
    )
    small = F.broadcast if size["bytes"] <= BROADCAST_BYTES else lambda df: df
    places = rows.join(small(plan.where("__pl_rest > 0")), names).withColumn("__pl_key", F.xxhash64("doc_id", "__pl_t", F.lit(seed), F.col("__pl_full")))
    places = places.groupBy(*names, "__pl_key").agg(F.sum("__pl_n").alias("__pl_n"), F.first("__pl_rest").alias("__pl_rest"))
    last = with_running_sum(places, names, ["__pl_key"], "__pl_n").where("__pl_cum <= __pl_rest")
    last = last.groupBy(*names).agg(F.max("__pl_key").alias("__pl_last"))
    return names, rows, small(durable(plan.join(last, names, "left").drop("__pl_rest")))


def _named(levels: list[str], names: list[str]) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)]


def _hash():
    return F.xxhash64(F.col("text").cast("string"))


def _copies(seed: int):
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("__pl_t"), F.lit(seed), F.col("__pl_full"))
    return (F.col("__pl_full") + F.when(key <= F.col("__pl_last"), 1).otherwise(0)).cast("int")


def select(
    docs: DataFrame,
    weights: dict = WEIGHTS,
    levels: list[str] = LEVELS,
    budget_share: float = BUDGET_SHARE,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, the levels, n_tokens, budget (of the leaf) and copies (0 or more) for every row.

    ``docs`` has doc_id, text and a column for each level.
    """
    names, rows, plan = _planned(docs, weights, levels, budget_share, epochs, seed)
    return rows.join(plan, names).select(
        "doc_id", *[F.col(n).alias(c) for c, n in zip(levels, names)], F.col("__pl_n").alias("n_tokens"), F.col("__pl_budget").alias("budget"),
        _copies(seed).alias("copies"),
    )


def domain_of(source):
    """The tables name no domain; sources are dealt to four by their number."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.concat(F.lit("d"), F.when(n == "", "x").otherwise(F.pmod(F.crc32(n), F.lit(4)).cast("string")))


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", domain_of(F.col("source")))


def mix(
    docs: DataFrame,
    weights: dict = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with each row as often as its leaf's epochs and prefix take it."""
    levels = ["__pl_domain", "lang", "source"]
    own = docs.withColumn("__pl_domain", domain_of(F.col("source")))
    names, _, plan = _planned(own, {**weights, "__pl_domain": weights["domain"]}, levels, budget_share, epochs, seed)
    taken = own.select("*", *_named(levels, names), _hash().alias("__pl_t")).join(plan, names)
    taken = taken.withColumn("__pl_copies", _copies(seed)).where("__pl_copies > 0")
    return taken.withColumn("__pl_copy", F.explode(F.sequence(F.lit(1), F.col("__pl_copies")))).select(*docs.columns)


def op2_query(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return select(with_domain(docs))
