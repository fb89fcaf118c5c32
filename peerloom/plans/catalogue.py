"""Named queries: each operator bound to the supplied tables, with the same query in DuckDB SQL.

``embeddings`` stand for tensors (label = receiving node, vec_id = sender),
``events`` for messages, ``supplier`` and ``nation`` for nodes, ``lineitem`` for samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec, rng, scalars
from ..operators import aggregate, rounds, tensors, topology
from ..operators.order import with_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return fn

    return add


def elements(t: Tables, cast: str = "float") -> DataFrame:
    """label, vec_id, idx, value: the elements of all vectors."""
    return t.embeddings.select("label", "vec_id", F.posexplode("embedding").alias("idx", "value")).withColumn(
        "value", F.col("value").cast(cast)
    )


# DuckDB's side of elements(): the same rows.
E = (
    "e as (select label, vec_id, unnest(range(0, 64))::int idx, unnest(embedding)::float value from embeddings)"
)
MEANS = "m as (select label, idx, avg(value::double) value, count(*) n from e group by label, idx)"


def means(t: Tables) -> DataFrame:
    return elements(t, "double").groupBy("label", "idx").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("sample_count"))


# ---- weighted averaging ----------------------------------------------------------------------


@query("weighted_avg", f"""
with {E} select label, idx, round(sum((vec_id % 7 + 1) * value::double) / sum(vec_id % 7 + 1), 6) as value from e group by label, idx""")
def weighted_avg(t):
    u = elements(t).withColumn("sample_count", F.col("vec_id") % 7 + 1)
    return aggregate.weighted_average(u, ["label", "idx"]).withColumn("value", F.round("value", 6))


@query("weighted_avg_full_mesh", f"""
with {E}, {MEANS}, r as (select distinct label receiver from embeddings)
select receiver, idx, round(sum(n * value) / sum(n), 6) as value from r, m group by receiver, idx""")
def weighted_avg_full_mesh(t):
    # In a mesh all receivers get one result: it is computed once and handed to each.
    one = aggregate.weighted_average(means(t), ["idx"])
    nodes = t.embeddings.select(F.col("label").alias("receiver")).distinct()
    return nodes.crossJoin(one).select("receiver", "idx", F.round("value", 6).alias("value"))


@query("weighted_avg_ring", f"""
with {E}, {MEANS}, p as (select distinct label r, label s from embeddings union select distinct label, (label + 1) % 10 from embeddings
 union select distinct (label + 1) % 10, label from embeddings)
select r as receiver, idx, round(sum(n * value) / sum(n), 6) as value from p join m on m.label = p.s group by r, idx""")
def weighted_avg_ring(t):
    nodes = t.embeddings.select(F.col("label").alias("id")).distinct()
    links = nodes.select(F.col("id").alias("source"), ((F.col("id") + 1) % 10).alias("target"))
    both = links.select(F.col("source").alias("r"), F.col("target").alias("s")).union(links.select("target", "source"))
    peers = both.union(nodes.select("id", "id")).distinct().toDF("receiver", "label")
    got = peers.join(means(t), "label")
    return aggregate.weighted_average(got, ["receiver", "idx"]).withColumn("value", F.round("value", 6))


@query("weighted_avg_zero_samples", f"""
with {E}, w as (select *, case when label % 2 = 0 then 0 else vec_id % 7 end n from e),
l as (select label, idx, value::double value from e where vec_id in (select min(vec_id) from e group by label)),
s as (select label, idx, sum(n) n, sum(n * value::double) v from w group by label, idx)
select label as receiver, idx, round(case when s.n = 0 then l.value else s.v / s.n end, 6) as value from s join l using (label, idx)""")
def weighted_avg_zero_samples(t):
    """Receivers with even labels hear of no sample and keep their local tensor, that of their first vector."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    local = first.select(F.col("label").alias("receiver"), F.posexplode("v").alias("idx", "value")).withColumn("value", F.col("value").cast("double"))
    n = F.when(F.col("label") % 2 == 0, 0).otherwise(F.col("vec_id") % 7)
    u = elements(t).select(F.col("label").alias("receiver"), "idx", "value", n.alias("sample_count"))
    return aggregate.average_or_local(u, local, ["receiver", "idx"]).withColumn("value", F.round("value", 6))


# ---- codecs ----------------------------------------------------------------------------------

TOP = f"""{E}, t as (select *, row_number() over (partition by vec_id order by abs(value) desc, idx) <= 6 as kept from e)"""


def top(t):
    return codec.top_k(elements(t), ["vec_id"], 6)


@query("topk_magnitude", f"with {TOP} select vec_id, idx, value from t where kept")
def topk_magnitude(t):
    return top(t).where("kept").select("vec_id", "idx", "value")


@query("topk_residual", f"with {TOP} select vec_id, idx, case when kept then 0::float else value end as residual from t")
def topk_residual(t):
    return codec.residual(top(t)).select("vec_id", "idx", "residual")


@query("topk_plus_residual", f"with {TOP} select vec_id, idx, (case when kept then value else value / 2 end)::float as value from t")
def topk_plus_residual(t):
    r = codec.residual(top(t))
    sent = F.when(F.col("kept"), F.col("value")).otherwise(F.lit(0.0).cast("float"))
    # What is sent, and half of what is owed: the halves tell the two apart.
    return r.select("vec_id", "idx", (sent + F.col("residual") / 2).cast("float").alias("value"))


@query("fp16_roundtrip", f"""
with {E}, q as (select *, pow(2.0, greatest(floor(log2(abs(value::double))), -14) - 10) q from e where value <> 0)
select vec_id, idx, (round_even(value::double / q, 0) * q)::float as value from q
union all select vec_id, idx, value from e where value = 0""")
def fp16_roundtrip(t):
    return elements(t).select("vec_id", "idx", codec.fp16_roundtrip(F.col("value")).alias("value"))


RANGE = f"""{E}, g as (select vec_id, min(value) low, max(value) high from e group by vec_id),
s as (select *, case when high > low then ((high - low)::float / 255::float)::float else 1::float end scale from g),
q as (select vec_id, idx, low, scale, least(255, greatest(0, round((((value - low)::float / scale)::float)::double)))::int q
      from e join s using (vec_id))"""


def quantised(t):
    ranges = t.embeddings.select("vec_id", F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"))
    ranges = ranges.withColumn("scale", codec.int8_scale(F.col("low"), F.col("high"))).drop("high")
    return elements(t).join(ranges, "vec_id").withColumn("q", codec.int8_quantise(F.col("value"), F.col("low"), F.col("scale")))


@query("int8_quantise", f"with {RANGE} select vec_id, idx, q from q")
def int8_quantise(t):
    return quantised(t).select("vec_id", "idx", "q")


@query("int8_dequantise", f"with {RANGE} select vec_id, idx, round((low + (q::float * scale)::float)::double, 6) as value from q")
def int8_dequantise(t):
    v = codec.int8_dequantise(F.col("q"), F.col("low"), F.col("scale"))
    return quantised(t).select("vec_id", "idx", F.round(v.cast("double"), 6).alias("value"))


@query("sparse_to_dense", f"with {TOP} select vec_id, idx, case when kept then value else 0::float end as value from t")
def sparse_to_dense(t):
    entries = F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("entries")
    kept = top(t).where("kept").groupBy("vec_id").agg(entries)
    return kept.select("vec_id", F.posexplode(codec.sparse_to_dense(F.col("entries"), 64)).alias("idx", "value"))


@query("sparse_nnz", f"with {TOP} select vec_id, count(*) filter (where not kept and value <> 0) as nnz from t group by vec_id")
def sparse_nnz(t):
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", "residual"))), lambda e: e["residual"])
    rest = codec.residual(top(t)).groupBy("vec_id").agg(values.alias("v"))
    return rest.select("vec_id", F.size(codec.sparse_entries(F.col("v"))).cast("long").alias("nnz"))


BYTES = """b as (select label, vec_id, (vec_id % 4)::int encoding, len(embedding) n, 6 nnz from embeddings)"""
COST = "12 + case encoding when 0 then 4 * n when 2 then 2 * n when 3 then 8 + n else 4 + 8 * nnz end"


def sizes(t):
    n = F.size("embedding").alias("n")
    return t.embeddings.select("label", "vec_id", (F.col("vec_id") % 4).cast("int").alias("encoding"), n, F.lit(6).alias("nnz"))


@query("message_bytes", f"""
with {BYTES} select label, vec_id, (28 + {COST})::bigint as wire_bytes, (28 + 12 + 4 * n)::bigint as payload_bytes from b""")
def message_bytes(t):
    return codec.message_bytes(sizes(t), ["label", "vec_id"])


@query("realised_ratio", f"""
with {BYTES}, w as (select label, 28 + {COST} w, 28 + 12 + 4 * n p from b)
select label, round(sum(w) / sum(p), 9) as ratio from w group by label""")
def realised_ratio(t):
    m = codec.message_bytes(sizes(t), ["label", "vec_id"])
    return m.groupBy("label").agg(F.round(aggregate.realised_ratio(F.col("wire_bytes"), F.col("payload_bytes")), 9).alias("ratio"))


@query("encodings", "select * from (values (0, 'dense', false), (1, 'sparse', true), (2, 'fp16', true), (3, 'int8', true)) t(encoding, name, lossy)")
def encodings(t):
    from ..schemas import dimension

    return dimension(t.spark, codec.ENCODINGS, "encoding", "name").withColumn("lossy", codec.is_lossy(F.col("encoding")))


# ---- deltas ----------------------------------------------------------------------------------


@query("delta_apply", f"""
with {E}, {MEANS} select e.label, vec_id, idx, round(e.value::double - m.value + (idx + vec_id % 3) / 100.0, 6) as value from e join m using (label, idx)""")
def delta_apply(t):
    """Deltas against the label's mean, applied by receivers to bases of their own."""
    base = means(t).select("label", "idx", F.col("value").alias("base"))
    mine = (F.col("idx") + F.col("vec_id") % 3) / 100.0
    rows = elements(t, "double").join(base, ["label", "idx"])
    keys = ["label", "vec_id"]
    whole = rounds.apply_delta(
        rows.select(*keys, "idx", (F.col("value") - F.col("base")).alias("value")), rows.select(*keys, "idx", mine.alias("value")), keys
    )
    return whole.withColumn("value", F.round("value", 6))


@query("error_feedback_2round", f"""
with {E}, a as (select *, row_number() over (partition by vec_id order by abs(value) desc, idx) <= 6 k1 from e),
b as (select *, case when k1 then 0 else value::double end + value::double / 2 v2 from a),
c as (select *, row_number() over (partition by vec_id order by abs(v2) desc, idx) <= 6 k2 from b)
select vec_id, idx, round(v2, 6) as sent from c where k2""")
def error_feedback_2round(t):
    r1 = codec.residual(codec.top_k(elements(t), ["vec_id"], 6))
    r2 = r1.select("vec_id", "idx", (F.col("residual").cast("double") + F.col("value").cast("double") / 2).alias("value"))
    return codec.top_k(r2, ["vec_id"], 6).where("kept").select("vec_id", "idx", F.round("value", 6).alias("sent"))


# ---- random numbers --------------------------------------------------------------------------


def splitmix_sql(column: str, source: str, out: str) -> str:
    """A chain of CTEs that mixes the UBIGINT ``column`` of ``source``."""
    big = "18446744073709551616::uhugeint"
    return f"""
{out}1 as (select *, ((xor({column}, {column} >> 30)::uhugeint * 13787848793156543929::uhugeint) % {big})::ubigint z1 from {source}),
{out}2 as (select *, ((xor(z1, z1 >> 27)::uhugeint * 10723151780598845931::uhugeint) % {big})::ubigint z2 from {out}1),
{out} as (select *, xor(z2, z2 >> 31) bits from {out}2)"""


STEP = "((({seed})::uhugeint + 11400714819323198485::uhugeint * ({k})::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


@query("splitmix_uniform", f"""
with s as (select o_orderkey, {STEP.format(seed='o_orderkey', k='1')} z from orders), {splitmix_sql('z', 's', 'm')}
select o_orderkey, bits::varchar as bits, ((bits >> 11)::double * pow(2.0, -53)) as uniform from m""")
def splitmix_uniform(t):
    x = t.orders.select("o_orderkey", rng.output(F.col("o_orderkey"), 1).alias("x"))
    return x.select("o_orderkey", rng.unsigned_text(F.col("x")).alias("bits"), rng.uniform(F.col("x")).alias("uniform"))


@query("round_seed", f"""
with r as (select o_orderkey, unnest(range(1, 4))::int round from orders),
s as (select *, {STEP.format(seed='o_orderkey', k='round + 1')} z from r), {splitmix_sql('z', 's', 'm')}
select o_orderkey, round, bits::varchar as seed from m""")
def round_seed(t):
    r = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("round"))
    return r.select("o_orderkey", "round", rng.unsigned_text(rng.round_seed(F.col("o_orderkey"), F.col("round"))).alias("seed"))


CHURN = f"""p as (select s_suppkey, unnest(range(1, 21))::int round from supplier),
s as (select *, ((7::uhugeint + 11400714819323198485::uhugeint * (round + 2)::uhugeint
 + (13787848793156543929::uhugeint * s_suppkey::uhugeint) % 18446744073709551616::uhugeint) % 18446744073709551616::uhugeint)::ubigint z from p),
{splitmix_sql('z', 's', 'm')}, c as (select s_suppkey, round, (bits >> 11)::double * pow(2.0, -53) < 0.3 dropped from m)"""


def draws(t):
    rows = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("round"))
    return rows.withColumn("dropped", rounds.churn_dropped(7, F.col("round"), F.col("s_suppkey"), 0.3))


@query("churn_decision", f"with {CHURN} select s_suppkey, round from c where dropped")
def churn_decision(t):
    return draws(t).where("dropped").select("s_suppkey", "round")


@query("churn_split", f"""
with {CHURN} select round, count(*) filter (where not dropped) as kept, count(*) filter (where dropped) as dropped from c group by round""")
def churn_split(t):
    d = F.col("dropped")
    return draws(t).groupBy("round").agg(F.count_if(~d).alias("kept"), F.count_if(d).alias("dropped"))


@query("he_normals", f"""
with r as (select unnest(range(0, 432))::bigint i), s as (select i, (i // 2) * 2 j from r),
a as (select i, {STEP.format(seed='42', k='j + 1')} z from s), {splitmix_sql('z', 'a', 'ma')},
b as (select i, {STEP.format(seed='42', k='j + 2')} z from s), {splitmix_sql('z', 'b', 'mb')},
u as (select ma.i, (ma.bits >> 11)::double * pow(2.0, -53) u1, (mb.bits >> 11)::double * pow(2.0, -53) u2 from ma join mb using (i))
select i::int as idx, round(sqrt(-2 * ln(u1)) * (case when i % 2 = 0 then cos(2 * pi() * u2) else sin(2 * pi() * u2) end) * sqrt(2.0 / 27), 6) as value
from u""")
def he_normals(t):
    v = rng.normal(F.lit(42), F.col("id")) * F.sqrt(F.lit(2.0 / 27))
    return t.spark.range(432).select(F.col("id").cast("int").alias("idx"), F.round(v, 6).alias("value"))


# ---- sampling order, batches, chunks ---------------------------------------------------------

HASH = "((l_orderkey * 2654435761 + l_linenumber) % 1000003)"


@query("seeded_order_batches", f"""
with r as (select l_suppkey, l_orderkey, row_number() over (partition by l_suppkey order by {HASH}, l_orderkey, l_linenumber) - 1 pos,
 count(*) over (partition by l_suppkey) n from lineitem)
select l_suppkey, (pos // 32)::int as batch, count(*) as samples, sum(l_orderkey)::bigint as keys from r where pos < n // 32 * 32 group by 1, 2""")
def seeded_order_batches(t):
    order = [F.expr(HASH), F.col("l_orderkey"), F.col("l_linenumber")]
    b = rounds.batch_numbers(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], order, 32)
    return b.groupBy("l_suppkey", "batch").agg(F.count(F.lit(1)).alias("samples"), F.sum("l_orderkey").alias("keys"))


@query("even_chunks", "select p_size, ntile(4) over (partition by p_size order by p_partkey) as chunk, p_partkey from part")
def even_chunks(t):
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    return t.part.select("p_size", F.ntile(4).over(w).alias("chunk"), "p_partkey")


@query("node_position", "select n_nationkey, n_name, (row_number() over (order by n_nationkey) - 1)::int as node_idx from nation")
def node_position(t):
    return topology.positions(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


@query("progress_ticks", """
select l_suppkey, count(*) filter (where l_linenumber % 3 = 0) as ticks from lineitem group by l_suppkey""")
def progress_ticks(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_linenumber") % 3 == 0).alias("ticks"))


# ---- topology --------------------------------------------------------------------------------


def nation_nodes(t):
    return t.nation.select(F.col("n_nationkey").alias("id"))


@query("mesh_peers", "select a.n_nationkey as node_id, b.n_nationkey as peer_id from nation a, nation b where a.n_nationkey <> b.n_nationkey")
def mesh_peers(t):
    return topology.mesh_peers(nation_nodes(t))


RING = "l as (select n_nationkey source, n_nationkey + 1 target from nation)"


def ring_links(t):
    return t.nation.select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") + 1).alias("target"))


@query("ring_peers", f"""
with {RING}, b as (select source a, target b from l union select target, source from l)
select a as node_id, b as peer_id from b where a in (select n_nationkey from nation) and b in (select n_nationkey from nation)""")
def ring_peers(t):
    return topology.link_peers(nation_nodes(t), ring_links(t))


@query("duplicate_ids", "select n_regionkey as id, count(*) as n from nation group by 1 having count(*) > 1")
def duplicate_ids(t):
    return topology.duplicate_ids(t.nation.select(F.col("n_regionkey").alias("id")))


@query("unknown_ids", f"""
with {RING} select id from (select source id from l union select target from l) where id not in (select n_nationkey from nation)""")
def unknown_ids(t):
    return topology.unknown_ids(nation_nodes(t), ring_links(t))


@query("node_lookup", """
select s_suppkey, coalesce(n_name, 'node#' || s_nationkey) as node from supplier left join (select * from nation where n_nationkey < 20) on n_nationkey = s_nationkey""")
def node_lookup(t):
    known = t.nation.where("n_nationkey < 20").select("n_nationkey", "n_name")
    j = t.supplier.join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("node#"), F.col("s_nationkey"))).alias("node"))


@query("startup_exclusion", """
select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_shipdate < timestamp '1992-03-01')""")
def startup_exclusion(t):
    ready = t.lineitem.where("l_shipdate < timestamp_ntz'1992-03-01'").select(F.col("l_suppkey").alias("s_suppkey"))
    return rounds.missing(ready, t.supplier.select("s_suppkey"), ["s_suppkey"])


# ---- rounds on the event stream --------------------------------------------------------------

DAYS = "d as (select distinct ts::date as round from events), u as (select distinct user_id from events)"


def daily(t):
    return t.events.withColumn("round", F.to_date("ts"))


def expected(t):
    """Every user in every round (days are few: the round axis of the run)."""
    ev = daily(t)
    return ev.select("user_id").distinct().crossJoin(F.broadcast(ev.select("round").distinct()))


@query("expected_received", f"""
with {DAYS} select round, user_id from d, u where exists (select 1 from events e where e.ts::date = round and e.user_id = u.user_id)""")
def expected_received(t):
    return rounds.received(expected(t).select("round", "user_id"), daily(t), ["round", "user_id"])


@query("missing_peers", f"""
with {DAYS} select round, user_id from d, u except select ts::date, user_id from events""")
def missing_peers(t):
    return rounds.missing(daily(t), expected(t).select("round", "user_id"), ["round", "user_id"])


@query("deadline_outcome", """
with f as (select ts::date as round, user_id, min(ts) a from events group by 1, 2),
s as (select round, case when a <= round::timestamp + interval 12 hours then 1 else 0 end ok from f)
select round, sum(ok)::int as peers_reached, count(*)::int as peers_expected, sum(1 - ok)::int as peers_timed_out, 0 as peers_churn_dropped,
 case when sum(1 - ok) = 0 then 'completed' else 'partial_peers_unreachable' end as round_status from s group by round""")
def deadline_outcome(t):
    first = daily(t).groupBy("round", "user_id").agg(F.min("ts").alias("arrival"))
    start = F.col("round").cast("timestamp_ntz")
    return aggregate.counters(first.withColumn("status", rounds.deadline_status(F.col("arrival"), start, "12 hours")), ["round"])


@query("late_discard", "select event_id from events where ts > ts::date::timestamp + interval 12 hours")
def late_discard(t):
    ev = daily(t)
    status = rounds.deadline_status(F.col("ts"), F.col("round").cast("timestamp_ntz"), "12 hours")
    return ev.where(status == "timed_out").select("event_id")


@query("last_write_wins", """
select ts::date as round, user_id, event_id, value from events qualify row_number() over (partition by ts::date, user_id order by ts desc, event_id desc) = 1""")
def last_write_wins(t):
    return aggregate.last_write(daily(t), ["round", "user_id"], ["ts", "event_id"], ["event_id", "value"])


@query("prune_rounds", "select ts::date as round, count(*) as messages from events where ts::date >= date '2024-01-15' group by 1")
def prune_rounds(t):
    import datetime

    kept = rounds.prune(daily(t), datetime.date(2024, 1, 15))
    return kept.groupBy("round").agg(F.count(F.lit(1)).alias("messages"))


@query("sticky_fallback", """
with d as (select event_type, ts::date as round, bool_or(value > 330) lost from events group by 1, 2)
select event_type, round, lost, bool_or(lost) over (partition by event_type order by round rows unbounded preceding) as fallback from d""")
def sticky_fallback(t):
    days = daily(t).groupBy("event_type", "round").agg(F.bool_or(F.col("value") > 330).alias("lost"))
    return rounds.sticky_fallback(days, ["event_type"], "round", "lost")


@query("liveness_transitions", """
with l as (select user_id, event_id, event_type <> 'error' up, lag(event_type <> 'error', 1, false) over (partition by user_id order by ts, event_id) was from events)
select user_id, event_id, up from l where up <> was""")
def liveness_transitions(t):
    probes = t.events.select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("up"))
    return rounds.liveness_transitions(probes, ["user_id"], ["ts", "event_id"], "up").select("user_id", "event_id", "up")


@query("peers_up", """
with l as (select user_id, max_by(event_type <> 'error', (ts, event_id)) up from events group by 1) select count(*) filter (where up) as up, count(*) as peers from l""")
def peers_up(t):
    probes = t.events.withColumn("up", F.col("event_type") != "error")
    last = aggregate.last_write(probes, ["user_id"], ["ts", "event_id"], ["up"])
    return last.agg(F.count_if("up").alias("up"), F.count(F.lit(1)).alias("peers"))


@query("retry_backoff", """
with a as (select s_suppkey, unnest(range(0, 10))::int attempt from supplier) select s_suppkey, attempt, least(0.5 * pow(2.0, attempt), 5.0)::double as wait_s from a""")
def retry_backoff(t):
    return t.supplier.select("s_suppkey", F.posexplode(scalars.backoff(10)).alias("attempt", "wait_s"))


@query("push_wait_overlap", """
select ts::date as round, greatest(min(value), max(value) / 2) as wait_s, round(min(value) + max(value) / 2, 6) as serial_s from events group by 1""")
def push_wait_overlap(t):
    push, wait = F.min("value"), F.max("value") / 2
    return daily(t).groupBy("round").agg(F.greatest(push, wait).alias("wait_s"), F.round(push + wait, 6).alias("serial_s"))


@query("push_summary", """
select event_type, count(*) filter (where value < 300) as ok, count(*) filter (where value >= 300) as failed from events group by 1""")
def push_summary(t):
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") < 300).alias("ok"), F.count_if(F.col("value") >= 300).alias("failed"))


@query("idle_gaps", """
with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours, true) fresh from events)
select user_id, sum(fresh::int)::bigint as sessions from g group by 1""")
def idle_gaps(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")
    return t.events.select("user_id", F.coalesce(gap, F.lit(True)).cast("long").alias("fresh")).groupBy("user_id").agg(F.sum("fresh").alias("sessions"))


# ---- tensor kernels --------------------------------------------------------------------------


@query("gram_matmul", f"""
with {E}, s as (select * from e) select a.label, a.idx as i, b.idx as j, round(sum(a.value::double * b.value::double), 4) as value
from s a join s b using (vec_id) group by 1, 2, 3""")
def gram_matmul(t):
    s = elements(t, "double")
    left, right = s.select("label", F.col("idx").alias("i"), F.col("vec_id").alias("k"), "value"), s.select("label", F.col("vec_id").alias("k"), F.col("idx").alias("j"), "value")
    return tensors.matmul(left, right, ["label"]).withColumn("value", F.round("value", 4))


@query("gram_transpose", f"""
with {E}, s as (select * from e) select a.idx as j, b.idx as i, round(sum(a.value::double * b.value::double), 4) as value
from s a join s b using (vec_id) where a.idx <= b.idx group by 1, 2""")
def gram_transpose(t):
    s = elements(t, "double")
    g = tensors.matmul(s.select(F.col("idx").alias("i"), F.col("vec_id").alias("k"), "value"), s.select(F.col("vec_id").alias("k"), F.col("idx").alias("j"), "value"))
    return tensors.transpose(g.where("i <= j")).withColumn("value", F.round("value", 4)).select("i", "j", "value")


LOGITS = f"""{E}, z as (select vec_id, label, c, sum(value::double * ((idx * 7 + c * 3) % 5 - 2)) z from e, (select unnest(range(0, 10))::int c) group by 1, 2, 3),
x as (select *, exp(z - max(z) over (partition by vec_id)) ex from z), p as (select *, ex / sum(ex) over (partition by vec_id) p from x)"""


def probabilities(t):
    """vec_id, label, z (logits), p: a dense layer with fixed integer weights, row by row on arrays."""
    weight = lambda i, c: (F.pmod(i * 7 + c * 3, F.lit(5)) - 2).cast("double")
    column = lambda c: F.aggregate(
        F.transform("embedding", lambda v, i: v.cast("double") * weight(i, c)), F.lit(0.0), lambda s, x: s + x
    )
    z = t.embeddings.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(9)), column).alias("z"))
    return z.withColumn("p", scalars.softmax(F.col("z")))


@query("fc_forward_softmax", f"with {LOGITS} select vec_id, c as class, round(p, 6) as p from p")
def fc_forward_softmax(t):
    return probabilities(t).select("vec_id", F.posexplode("p").alias("class", "p")).withColumn("p", F.round("p", 6))


@query("argmax_first", f"with {E}, r as (select vec_id, idx, round(value::double, 1) v from e) select vec_id, min(idx)::int as first from r join (select vec_id, max(v) v from r group by 1) using (vec_id, v) group by 1")
def argmax_first(t):
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return t.embeddings.select("vec_id", scalars.argmax_first(v).alias("first"))


@query("cross_entropy", f"with {LOGITS} select vec_id, round(-ln(p + 1e-9), 6) as loss from p where c = label")
def cross_entropy(t):
    hit = F.get("p", F.col("label"))
    return probabilities(t).select("vec_id", F.round(scalars.cross_entropy(hit), 6).alias("loss"))


@query("ce_gradient", f"with {LOGITS} select vec_id, c as class, round((p - case when c = label then 1 else 0 end) / 32, 7) as d from p")
def ce_gradient(t):
    d = F.transform("p", lambda x, i: (x - F.when(i == F.col("label"), 1.0).otherwise(0.0)) / 32)
    return probabilities(t).select("vec_id", F.posexplode(d).alias("class", "d")).withColumn("d", F.round("d", 7))


@query("accuracy_full_batches", f"""
with {LOGITS}, g as (select vec_id, label, c pred from p qualify row_number() over (partition by vec_id order by round(z, 6) desc, c) = 1), r as (select *, row_number() over (order by vec_id) - 1 pos, count(*) over () n from g)
select count(*) as samples, round(avg((pred = label)::int), 9) as accuracy from r where pos < n // 32 * 32""")
def accuracy_full_batches(t):
    return scored(t).agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("accuracy"))


def scored(t):
    """Rows of full batches of 32 in the order of vec_id, with their batch."""
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(probabilities(t), ["vec_id"])
    rows = placed.crossJoin(F.broadcast(n)).where("__pl_pos < floor(n / 32) * 32")
    loss = scalars.cross_entropy(F.get("p", F.col("label")))
    z = F.transform("z", lambda x: F.round(x, 6))  # classes 5 apart have equal weights: ties are exact
    batch = F.floor(F.col("__pl_pos") / 32).alias("batch")
    return rows.select("vec_id", batch, loss.alias("loss"), (scalars.argmax_first(z) == F.col("label")).alias("hit"))


@query("mean_batch_loss", f"""
with {LOGITS}, o as (select *, row_number() over (order by vec_id) - 1 pos from p where c = label),
r as (select pos // 32 b, -ln(p + 1e-9) l from o where pos < (select count(*) // 32 * 32 from embeddings)),
b as (select b, avg(l) l from r group by 1) select count(*) as batches, round(avg(l), 6) as loss from b""")
def mean_batch_loss(t):
    b = scored(t).groupBy("batch").agg(F.avg("loss").alias("l"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("l"), 6).alias("loss"))


@query("relu", f"with {E} select vec_id, idx, greatest(value, 0)::float as value from e")
def relu(t):
    return elements(t).select("vec_id", "idx", scalars.relu(F.col("value")).cast("float").alias("value"))


@query("relu_backward", f"with {E} select vec_id, idx, case when value > 0 then idx else 0 end::double as d from e")
def relu_backward(t):
    return elements(t).select("vec_id", "idx", scalars.relu_backward(F.col("value"), F.col("idx").cast("double")).alias("d"))


@query("bias_grad", f"with {E} select label, idx, round(sum(value::double), 5) as grad from e group by 1, 2")
def bias_grad(t):
    return elements(t, "double").groupBy("label", "idx").agg(F.round(F.sum("value"), 5).alias("grad"))


@query("dot_product", f"with {E} select vec_id, round(sum(value::double * value::double), 6) as dot from e group by 1")
def dot_product(t):
    return t.embeddings.select("vec_id", F.round(scalars.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"))


PIXELS = f"{E}, x as (select vec_id, idx // 8 y, idx % 8 x, round(value::double, 1) value from e)"


def pixels(t):
    y = F.floor(F.col("idx") / 8).cast("int").alias("y")
    return elements(t, "double").select("vec_id", y, (F.col("idx") % 8).alias("x"), F.round("value", 1).alias("value"))


PATCHES = f"""{PIXELS}, k as (select a.k kh, b.k kw from (select unnest(range(0, 3))::int k) a, (select unnest(range(0, 3))::int k) b),
q as (select vec_id, y - kh oh, x - kw ow, kh, kw, value from x, k where y - kh between 0 and 5 and x - kw between 0 and 5)"""


@query("im2col_8x8", f"with {PATCHES} select vec_id, oh::int as oh, ow::int as ow, kh, kw, value from q")
def im2col_8x8(t):
    return tensors.im2col(pixels(t), ["vec_id"], 8, 3)


@query("conv_valid_3x3", f"with {PATCHES} select vec_id, oh::int as oh, ow::int as ow, round(sum(value * (kh * 3 + kw - 4)), 4) as value from q group by 1, 2, 3")
def conv_valid_3x3(t):
    k = t.spark.range(9).select((F.col("id") / 3).cast("int").alias("kh"), (F.col("id") % 3).cast("int").alias("kw"), (F.col("id") - 4).cast("double").alias("w"))
    return tensors.conv(pixels(t), k, ["vec_id"], 8, 3).withColumn("value", F.round("value", 4))


@query("conv_padded_3x3", f"""
with {PIXELS}, k as (select a.k kh, b.k kw from (select unnest(range(0, 3))::int k) a, (select unnest(range(0, 3))::int k) b)
select vec_id, (y + 1 - kh)::int as oh, (x + 1 - kw)::int as ow, round(sum(value * (kh * 3 + kw - 4)), 4) as value from x, k
where y + 1 - kh between 0 and 7 and x + 1 - kw between 0 and 7 group by 1, 2, 3""")
def conv_padded_3x3(t):
    k = t.spark.range(9).select((F.col("id") / 3).cast("int").alias("kh"), (F.col("id") % 3).cast("int").alias("kw"), (F.col("id") - 4).cast("double").alias("w"))
    return tensors.conv(pixels(t), k, ["vec_id"], 8, 3, 1).withColumn("value", F.round("value", 4))


@query("col2im_8x8", f"with {PATCHES} select vec_id, (oh + kh)::int as y, (ow + kw)::int as x, round(sum(value), 4) as value from q group by 1, 2, 3")
def col2im_8x8(t):
    return tensors.col2im(tensors.im2col(pixels(t), ["vec_id"], 8, 3), ["vec_id"]).withColumn("value", F.round("value", 4))


POOL = f"""{PIXELS}, w as (select *, y // 2 oh, x // 2 ow from x), t as (select *, max(value) over (partition by vec_id, oh, ow) top from w),
c as (select *, count(*) filter (where value = top) over (partition by vec_id, oh, ow) ties from t)"""


@query("maxpool_ties", f"with {POOL} select vec_id, y::int as y, x::int as x, top, case when value = top then 1.0::double / ties else 0 end as share from c")
def maxpool_ties(t):
    return tensors.max_pool(pixels(t), ["vec_id"], 8).select("vec_id", "y", "x", "top", "share")


@query("maxpool_backward", f"with {POOL} select vec_id, y::int as y, x::int as x, round((oh * 4 + ow) * case when value = top then 1.0::double / ties else 0 end, 6) as dx from c")
def maxpool_backward(t):
    p = tensors.max_pool(pixels(t), ["vec_id"], 8)
    return p.select("vec_id", "y", "x", F.round((F.col("oh") * 4 + F.col("ow")) * F.col("share"), 6).alias("dx"))


@query("reshape_nchw", f"with {E} select vec_id, (idx % 4)::int as c, (idx // 4)::int as hw, value from e")
def reshape_nchw(t):
    return elements(t).select("vec_id", (F.col("idx") % 4).alias("c"), F.floor(F.col("idx") / 4).cast("int").alias("hw"), "value")


@query("sgd_momentum_3steps", f"""
with {E}, a as (select *, value::double w, 0.01 * value::double g from e), s1 as (select *, -0.01::double * value::double v1 from a),
s2 as (select *, 0.9::double * v1 - 0.01::double * value::double v2 from s1), s3 as (select *, 0.9::double * v2 - 0.01::double * value::double v3 from s2)
select vec_id, idx, round(w + v1 + v2 + v3, 6) as w, round(v3, 7) as v from s3""")
def sgd_momentum_3steps(t):
    rows = elements(t, "double").select("vec_id", "idx", F.col("value").alias("w"), F.lit(0.0).alias("v"), F.col("value").alias("g"))
    for _ in range(3):
        w, v = tensors.sgd_step(F.col("w"), F.col("v"), F.col("g"), 0.01)
        rows = rows.select("vec_id", "idx", w.alias("w"), v.alias("v"), "g")
    return rows.select("vec_id", "idx", F.round("w", 6).alias("w"), F.round("v", 7).alias("v"))


# ---- inspection, strings, telemetry ----------------------------------------------------------


@query("inspect_stats", f"with {E} select count(*) as n, min(value) as low, max(value) as high, round(avg(value::double), 6) as mean, count(distinct value) as different from e")
def inspect_stats(t):
    v = F.col("value")
    return elements(t).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v.cast("double")), 6).alias("mean"), F.count_distinct(v).alias("different"))


@query("label_stats", "select label, count(*) as n, list(vec_id order by vec_id)[1:3] as first from embeddings group by label")
def label_stats(t):
    # The three smallest ids without a list of all: ranked before they are gathered.
    w = Window.partitionBy("label").orderBy("vec_id")
    few = t.embeddings.select("label", "vec_id", F.row_number().over(w).alias("r")).where("r <= 3")
    first = few.groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("first"))
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(first, "label")


CONDITIONS = ["iid", "alpha_0p1", "peq_iid", "peq_alpha_0p1_s43", "peq_iid_s43", "custom", "peq_custom", "alpha_abc"]


@query("condition_parse", """
select * from (values ('iid', 'dir', null::double, true), ('alpha_0p1', 'dir', 0.1, false), ('peq_iid', 'eq', null, true), ('peq_alpha_0p1_s43', 'eq', 0.1, false),
('peq_iid_s43', 'eq', null, true), ('custom', null, null, false), ('peq_custom', null, null, false), ('alpha_abc', 'dir', null, false)) t(raw, family, alpha, iid)""")
def condition_parse(t):
    raw = t.spark.createDataFrame([(c,) for c in CONDITIONS], "raw string")
    return raw.select("raw", *[c.alias(n) for n, c in scalars.condition(F.col("raw")).items()])


@query("node_numeric_id", "select 'pi-' || s_suppkey as name, s_suppkey as node_id from supplier")
def node_numeric_id(t):
    name = F.concat(F.lit("pi-"), F.col("s_suppkey"))
    return t.supplier.select(name.alias("name"), scalars.numeric_node_id(name).alias("node_id"))


@query("cpu_list_count", "select * from (values ('0-3', 4), ('0,2', 2), ('0-1,3', 3), ('0', 1), ('', -1), ('3-1', -1), ('a', -1)) t(list, cpus)")
def cpu_list_count(t):
    raw = t.spark.createDataFrame([(x,) for x in ("0-3", "0,2", "0-1,3", "0", "", "3-1", "a")], "list string")
    return raw.select("list", scalars.cpu_list_count(F.col("list")).alias("cpus"))


@query("pretty_name", "select n_nationkey, n_name as name from nation")
def pretty_name(t):
    text = F.concat(F.lit("ID=x\nPRETTY_NAME=\""), F.col("n_name"), F.lit("\"\nPRETTY_NAME=\"other\""))
    return t.nation.select("n_nationkey", scalars.pretty_name(text).alias("name"))


@query("shard_names", "select n_nationkey, 'node_' || lpad(n_nationkey::varchar, 2, '0') || '_train_X.npy' as file from nation")
def shard_names(t):
    return t.nation.select("n_nationkey", F.concat(F.lit("node_"), scalars.two_digits(F.col("n_nationkey")), F.lit("_train_X.npy")).alias("file"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("json_encode", """select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as line from events""")
def json_encode(t):
    return t.events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("sentinel_mean", "select o_orderstatus, round(avg(case when o_orderkey % 5 <> 0 then o_totalprice end), 4) as mean, count(*) filter (where o_orderkey % 5 = 0) as unmeasured from orders group by 1")
def sentinel_mean(t):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice"))
    seen = scalars.instrumented(raw)
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.avg(seen), 4).alias("mean"), F.count_if(seen.isNull()).alias("unmeasured"))


@query("eval_cadence", "select unnest(range(1, 26))::int as round, (unnest(range(1, 26)) % 5 = 0 or unnest(range(1, 26)) = 25) as evaluated")
def eval_cadence(t):
    r = t.spark.range(1, 26).select(F.col("id").cast("int").alias("round"))
    return r.withColumn("evaluated", scalars.evaluates(F.col("round"), 5, 25))


@query("time_formats", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as csv, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, epoch_us(ts) / 1000000.0::double as epoch_s from events")
def time_formats(t):
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("event_id", local.alias("csv"), F.concat(local, F.lit("Z")).alias("utc"), epoch.alias("epoch_s"))


@query("effective_cores", "select user_id, case when sum(value) > 0 then round(count(*) * 100 / sum(value), 6) else 0 end::double as cores from events group by 1")
def effective_cores(t):
    s = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("wall"))
    return s.select("user_id", F.round(aggregate.effective_cores(F.col("n") * 100.0, F.col("wall")), 6).alias("cores"))


@query("round_totals", "select ts::date as round, round(sum(value), 4) as elapsed_s, round(sum(case when event_type = 'view' then value else 0 end), 4) as eval_s, round(sum(case when event_type <> 'view' then value else 0 end), 4) as work_s from events group by 1")
def round_totals(t):
    view = F.col("event_type") == "view"
    return daily(t).groupBy("round").agg(
        F.round(F.sum("value"), 4).alias("elapsed_s"), F.round(F.sum(F.when(view, F.col("value")).otherwise(0.0)), 4).alias("eval_s"),
        F.round(F.sum(F.when(~view, F.col("value")).otherwise(0.0)), 4).alias("work_s"),
    )


@query("sample_shards", """
with n as (select n_name as node, row_number() over (order by n_name) - 1 as pos from nation)
select node, count(*) as samples, count(distinct l_orderkey) as different from lineitem join n on l_suppkey % 30 = pos group by 1""")
def sample_shards(t):
    """Samples join nodes by the nodes' position in their order; shards without a node are left out."""
    nodes = topology.positions(t.nation.select(F.col("n_name").alias("node")), ["node"])
    samples = t.lineitem.select((F.col("l_suppkey") % 30).alias("node_idx"), "l_orderkey")
    return samples.join(F.broadcast(nodes), "node_idx").groupBy("node").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("l_orderkey").alias("different")
    )


@query("paired_rows", "select l.label, count(*) as pairs from embeddings l join embeddings r using (vec_id) group by 1")
def paired_rows(t):
    from ..sources.npy import paired

    return paired(t.embeddings.select("vec_id", "embedding"), t.embeddings.select("vec_id", "label"), ["vec_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("pairs"))


# ---- operators without an SQL form -----------------------------------------------------------


@query("local_training", None)
def local_training(t):
    """One epoch of softmax regression on each label group's vectors (5 nodes of mixed classes)."""
    from . import nn

    import pandas as pd

    model = nn.SoftmaxRegression(64, 10)
    node = (F.col("vec_id") % 5).alias("node_id")
    samples = t.embeddings.select(node, F.col("vec_id").alias("sample_idx"), F.col("embedding").alias("image"), "label")
    start = t.spark.createDataFrame(pd.concat([nn.pack(n, model.start(42)) for n in range(5)]), nn.PARAM_ROWS)
    out = nn.train_nodes(samples, start, model, 42, 0.1)
    return out.where("tensor_id = 0").select("node_id", "n_samples", F.round("train_loss", 4).alias("train_loss"), F.round("train_acc", 4).alias("train_acc"))


@query("federated_rounds", None)
def federated_rounds(t):
    """Three rounds of five nodes in a full mesh with half-float messages."""
    from . import federation, nn

    node = (F.col("vec_id") % 5).alias("node_id")
    samples = t.embeddings.select(node, F.col("vec_id").alias("sample_idx"), F.col("embedding").alias("image"), "label")
    peers = topology.mesh_peers(t.spark.range(5))
    options = federation.RunOptions(rounds=3, learning_rate=0.1, compression="fp16")
    return federation.run(samples, peers, nn.SoftmaxRegression(64, 10), options)
