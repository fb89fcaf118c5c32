"""Operator 6: quotation linking.

Quote marks at the head of a line give its level. Lines of one level that
belong to one quoted passage are joined, normalised (A-Z lower-cased, white
space collapsed) and hashed; so is what each message says itself, outside
quotes and attribution lines ("... wrote:"). So are the parts of both: lines,
paragraphs and sentences. A message answers the latest earlier message of its
scope whose own words have the hash of its outermost quoted passage that is
found. Where no passage of a level is a whole message, the level's parts decide:
each stands for the latest earlier message that says it, and the message that
most parts stand for is answered (ties: the latest). Threads are the trees of these links; a thread
is listed parents first (by depth, then order) without quotes.

Every message is a node of its own, known by a hash of all its columns, and its
parent is strictly earlier, so that links cannot form a circle whatever the ids.

Edge cases: null or empty text has no own words, is never quoted and has no
parent; a message that only quotes keeps its parent and has empty own text;
several messages with equal words: the latest one before the reply counts
(ties: the largest id); a null order or scope is a value of its own and sorts
first; several messages with one id are linked each by what they say; rows equal
in all columns are one node and placed each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, with_position

MARK = re.compile(r"^((?:>[ \t]?)+)(.*)$", re.S)
WROTE = re.compile(r"^.{0,200}\bwrote:\s*$")
#: Pointer doubling reaches 2^rounds ancestors.
MAX_ROUNDS = 62


def parse(text) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and (level, text) of each quoted passage in order of its first line."""
    own, passages, open_ = [], [], {}
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        if not m:
            if not WROTE.match(line):
                own.append(line)
            if line.strip():
                open_ = {}
            continue
        level, rest = m[1].count(">"), m[2]
        if WROTE.match(rest):
            continue
        if level not in open_:
            open_[level] = []
            passages.append((level, open_[level]))
        open_[level].append(rest)
    return "\n".join(own).strip("\n"), [(k, "\n".join(v)) for k, v in passages]


def normalise(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def parts_of(text: str) -> set[bytes]:
    """Normalised lines, paragraphs and sentences (the latter over line ends) of a text."""
    out = set(map(normalise, text.split("\n")))
    for paragraph in re.split(r"\n\s*\n", text):
        whole = normalise(paragraph)
        out |= {whole, *re.split(rb"(?<=[.!?]) ", whole)}
    return out - {b""}


def parsed(messages: DataFrame) -> DataFrame:
    """node (hash of the message), msg_id, sent, scope, own, own_hash (null if empty), quoted: array of (level, hash, parts),
    said: hashes of own parts."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("parts", pa.list_(pa.binary()))]))
        for b in batches:
            nodes, owns, hashes, quoted, said = [], [], [], [], []
            for *ids, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                own, passages = parse(t)
                nodes.append(xxh3_128_digest(repr((*ids, t is None)).encode("utf-8", "surrogatepass") + (t or "").encode("utf-8", "surrogatepass")))
                n = normalise(own)
                owns.append(own)
                hashes.append(xxh3_128_digest(n) if n else None)
                said.append(sorted(map(xxh3_128_digest, parts_of(own))))
                quoted.append([
                    {"level": k, "hash": xxh3_128_digest(x), "parts": sorted(map(xxh3_128_digest, parts_of(v)))}
                    for k, v in passages if (x := normalise(v))
                ])
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), *b.columns[:3], pa.array(owns, pa.string()), pa.array(hashes, pa.binary()), pa.array(quoted, kind),
                 pa.array(said, pa.list_(pa.binary()))],
                names=["node", "msg_id", "sent", "scope", "own", "own_hash", "quoted", "said"],
            )

    return messages.select(
        F.col("msg_id").cast("long").alias("msg_id"), F.col("sent").cast("long").alias("sent"),
        F.col("scope").cast("string").alias("scope"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(
        run, "node binary, msg_id long, sent long, scope string, own string, own_hash binary, "
        "quoted array<struct<level:int,hash:binary,parts:array<binary>>>, said array<binary>"
    )


def _origins(said: DataFrame, quote: DataFrame) -> DataFrame:
    """``quote`` (scope, hash, sent, msg_id, node, level) with ``origin``: the latest earlier message (sent, msg_id, node) of
    ``said`` that has the same hash and scope; quotes without one go.

    One range shuffle, so that a passage that a third of all messages quote is spread over tasks: each partition
    finds its own latest messages, and the one message with which a passage enters a further partition is broadcast.
    """
    # Quotes sort before originals of the same moment: a parent is always strictly earlier.
    keys = ["scope", "hash", "sent", "__pl_kind", "msg_id", "node"]
    both = said.withColumn("level", F.lit(None).cast("int")).unionByName(quote).withColumn("__pl_kind", F.col("level").isNull().cast("int"))
    laid = durable(both.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__pl_mid", F.monotonically_increasing_id()))
    laid = laid.withColumn("__pl_part", F.shiftright("__pl_mid", 33))
    original = F.when(F.col("level").isNull(), F.struct("sent", "msg_id", "node"))
    before = Window.unboundedPreceding, -1
    ends = laid.groupBy("__pl_part", "scope", "hash").agg(F.max_by(original, F.when(F.col("level").isNull(), F.col("__pl_mid"))).alias("o"))
    over = F.last("o", ignorenulls=True).over(Window.partitionBy("scope", "hash").orderBy("__pl_part").rowsBetween(*before))
    carried = ends.select(F.col("__pl_part").alias("p"), F.col("scope").alias("s"), F.col("hash").alias("h"), over.alias("carried")).where("carried is not null")
    own = F.last(original, ignorenulls=True).over(Window.partitionBy("__pl_part", "scope", "hash").orderBy("__pl_mid").rowsBetween(*before))
    same = (F.col("__pl_part") == F.col("p")) & F.col("scope").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("h"))
    return (
        laid.withColumn("own", own)
        .where("level is not null")
        .join(F.broadcast(carried), same, "left")  # at most one passage of each partition began before it
        .select("node", "level", F.coalesce("own", "carried").alias("origin"))
        .where("origin is not null")
    )


def parents(rows: DataFrame) -> DataFrame:
    """node, parent (sent, msg_id, node) for the messages that answer another one; ``rows`` as from ``parsed``."""
    who = ["sent", "msg_id", "node"]
    said = rows.where("own_hash is not null").select("scope", F.col("own_hash").alias("hash"), *who)
    quote = rows.select("scope", F.explode("quoted").alias("q"), *who)
    whole = durable(
        _origins(said, quote.select("scope", F.col("q.hash").alias("hash"), *who, F.col("q.level").alias("level")))
        .groupBy("node")
        .agg(F.max(F.struct((-F.col("level")).alias("near"), "origin")).alias("w"))
        .select(F.col("node").alias("found"), (-F.col("w.near")).alias("upto"), F.col("w.origin").alias("by_whole"))
    )
    # Parts are looked up only at levels further out than that of a whole message, and only those that somebody asks for.
    parts = durable(
        quote.join(whole, F.col("node") == F.col("found"), "left")
        .where("upto is null or q.level < upto")
        .select("scope", F.explode("q.parts").alias("hash"), *who, F.col("q.level").alias("level"))
        .distinct()
    )
    asked = parts.select(F.col("scope").alias("s"), F.col("hash").alias("h")).distinct()
    own = rows.select("scope", F.explode("said").alias("hash"), *who)
    own = own.join(asked, F.col("hash").eqNullSafe(F.col("h")) & F.col("scope").eqNullSafe(F.col("s")), "left_semi")
    most = (
        _origins(own, parts)
        .groupBy("node", "level", "origin")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("node")
        .agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "origin")).alias("w"))
        .select("node", F.col("w.origin").alias("by_parts"))
    )
    return whole.join(most, F.col("node") == F.col("found"), "full").select(
        F.coalesce("node", "found").alias("node"), F.coalesce("by_parts", "by_whole").alias("parent")
    )


def threads(messages: DataFrame) -> DataFrame:
    """msg_id, parent_id, root_id, depth, place (0-based, in the thread), own: one row a message.

    ``messages`` has msg_id, sent (order), scope (a mailbox or list; links stay inside it) and text.
    """
    rows = durable(parsed(messages))
    links = durable(parents(rows))
    # Pointer doubling: up is an ancestor and depth the steps to it, until it has no parent.
    state = links.select("node", F.col("parent.node").alias("up"), F.lit(1).cast("long").alias("depth"))
    done = None
    for _ in range(MAX_ROUNDS):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        if done is not None:
            finished = done.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
            above = above.union(finished)
        step = durable(
            state.join(above, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("next").isNull().alias("ended"),
            )
        )
        ended = step.where("ended").drop("ended")
        done = ended if done is None else done.union(ended)
        state = step.where("not ended").drop("ended")
        if not state.limit(1).count():
            break
    roots = done.join(rows.select(F.col("node").alias("up"), F.col("msg_id").alias("root_id")).distinct(), "up").select(
        "node", F.col("up").alias("root"), "root_id", "depth"
    )
    full = (
        rows.select("node", "msg_id", "sent")
        .join(links.select("node", F.col("parent.msg_id").alias("parent_id")), "node", "left")
        .join(roots, "node", "left")
        .select("node", "msg_id", "sent", "parent_id", F.coalesce("root", "node").alias("root"),
                F.when(F.col("root").isNull(), F.col("msg_id")).otherwise(F.col("root_id")).alias("root_id"),
                F.coalesce("depth", F.lit(0)).alias("depth"))
    )
    order = with_position(full, ["root", "depth", "sent", "msg_id", "node"])
    first = order.groupBy(F.col("root").alias("r")).agg(F.min("__pl_pos").alias("first"))
    placed = order.join(first, F.col("root") == F.col("r")).select(
        "node", "msg_id", "parent_id", "root_id", "depth", (F.col("__pl_pos") - F.col("first")).alias("place")
    )
    return placed.join(rows.select("node", "own").dropDuplicates(["node"]), "node").drop("node")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as messages that quote the turn before (and, one level deeper, the one before that).

    The tables hold turns without quotes; this lays quotes under them. A turn that occurs twice is
    quoted by its smallest text.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    one = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def back(k):
        return one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said{k}"))

    mark = lambda text, sign: F.regexp_replace(text, "(?m)^", sign)
    body = F.concat_ws(
        "\n", "text", F.when(F.col("said1") != "", F.lit("On an earlier day they wrote:")),
        F.when(F.col("said1") != "", mark(F.col("said1"), "> ")), F.when(F.col("said2") != "", mark(F.col("said2"), "> > ")),
    )
    return (
        turns.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
        .select((F.col("conv_id") * 1048576 + F.col("turn")).alias("msg_id"), F.col("turn").alias("sent"),
                F.col("conv_id").cast("string").alias("scope"), body.alias("text"))
    )


def op6_query(spark, sf_dir) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    out = threads(as_mail(talk))
    return out.select("msg_id", "parent_id", "root_id", "depth", "place", F.md5(F.col("own").cast("binary")).alias("digest"))
