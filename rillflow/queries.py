"""One query per operator on the driver's tables, each beside the SQL that says the same.

``events`` is the stream (key user_id, offset event_id, time ts), ``orders`` a
stream keyed by customer, ``conversations`` a stream of texts.  As a table's
changelog, an ``error`` event deletes its key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import headers
from rillflow.functions.codec import Int64, Json
from rillflow.functions.partition import fnv1a, partition_of
from rillflow.operators import fold, joins, stats, table, visit
from rillflow.operators.assignment import copartition_plan
from rillflow.operators.loop import loop_hops, loopback
from rillflow.operators.view import TableView
from rillflow.plans.graph import Input, Join, Lookup, Loop, Output, Persist, Visitor, define_group, inputs
from rillflow.plans.options import ProcessorOptions
from rillflow.sources.envelope import NIL_DECODE, NIL_IGNORE, NIL_PROCESS, decoded, encoded, envelope, recover_range, union_inputs
from rillflow.sources.sinks import append_text
from rillflow.sources.topics import TopicManager, shared_folder
from rillflow.streaming.processor import FINAL, OUTPUT, count_handler, run_batch, run_state, run_until_quiet
from rillflow.streaming.runner import StreamProcessor
from rillflow.streaming.view import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def is_error():
    """Deletes, seen from the changelog's side."""
    return F.col("event_type") == "error"



def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """key, offset, timestamp, event_type, cents, props."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "props")


def changes(e: DataFrame) -> DataFrame:
    """Events as a changelog: value is cents, null on error."""
    return e.select("key", "offset", F.when(~is_error(), F.col("cents")).alias("value"))


E = """e as (select cast(user_id as varchar) as key, event_id as "offset", ts as "timestamp", event_type, cast(round(value * 100) as bigint) as cents, props from events)"""
RUN = 'over (partition by key order by "offset" rows between unbounded preceding and current row)'


@query(f'with {E} select key, "offset", "timestamp", event_type, cents from e')
def q01_input_scan(spark, d):
    return events(spark, d).select("key", "offset", "timestamp", "event_type", "cents")


@query(f'with {E} select key, "offset", cents as value from e')
def q02_int64_codec(spark, d):
    e = envelope(events(spark, d), "events", "key", "offset", "cents")
    return decoded(encoded(e, Int64()), Int64()).select("key", "offset", "value")


@query(f"with {E} select key, \"offset\", cast(json_extract(props, '$.k') as int) as k from e")
def q03_json_codec(spark, d):
    e = envelope(events(spark, d), "events", "key", "offset", F.encode("props", "UTF-8"))
    return decoded(e, Json("k int")).select("key", "offset", F.col("value.k").alias("k"))


def _nil(spark, d, how):
    e = events(spark, d)
    return decoded(encoded(envelope(changes(e), "events", "key", "offset", "value"), Int64()), Int64(), how).select("key", "offset", "value")


@query(f"with {E} select key, \"offset\", cents as value from e where event_type <> 'error'")
def q04_nil_ignore(spark, d):
    return _nil(spark, d, NIL_IGNORE)


@query(f"with {E} select key, \"offset\", case when event_type <> 'error' then cents end as value from e")
def q05_nil_process(spark, d):
    return _nil(spark, d, NIL_PROCESS)


@query(f"with {E} select key, \"offset\", case when event_type <> 'error' then cents else 0 end as value from e")
def q06_nil_decode(spark, d):
    return _nil(spark, d, NIL_DECODE)


@query(f"with {E} select key, \"offset\", cents * 2 as value from e where event_type = 'purchase' and cents > 5000")
def q07_filter_map(spark, d):
    return events(spark, d).filter((F.col("event_type") == "purchase") & (F.col("cents") > 5000)).select("key", "offset", (F.col("cents") * 2).alias("value"))


@query("select cast(conv_id as varchar) as key, turn as \"offset\", unnest(string_split(text, ' ')) as word from conversations where text is not null")
def q08_flatmap_emit(spark, d):
    c = read(spark, d, "conversations").filter(F.col("text").isNotNull())
    return c.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("offset"), F.explode(F.split("text", " ")).alias("word"))


@query(f"""with {E} select 'purchases' as topic, key, "offset", cents as value from e where event_type = 'purchase'
union all select 'large', key, "offset", cents from e where cents > 9000""")
def q09_multi_output(spark, d):
    # One pass: each message says which topics it goes to.
    e = events(spark, d)
    topics = F.array(F.when(F.col("event_type") == "purchase", F.lit("purchases")), F.when(F.col("cents") > 9000, F.lit("large")))
    return e.select(F.explode(F.filter(topics, lambda t: t.isNotNull())).alias("topic"), "key", "offset", F.col("cents").alias("value"))


FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length({k}) + 1), lambda i: ascii(substr({k}, i, 1))::UBIGINT)), lambda a, b: (xor(a, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


@query(f"""with {E}, h as (select key as old_key, event_type || '-' || key as key, "offset" from e), f as (select *, cast({FNV.format(k="key")} as bigint) as hash from h)
select old_key, key, "offset", hash, cast(abs(case when hash > 2147483647 then hash - 4294967296 else hash end) % 8 as int) as "partition" from f""")
def q10_rekey_partition(spark, d):
    e = events(spark, d).select(F.col("key").alias("old_key"), F.concat_ws("-", "event_type", "key").alias("key"), "offset")
    return e.withColumns({"hash": fnv1a(F.col("key")), "partition": partition_of(F.col("key"), 8)})


@query(f"with {E} select key, count(*) as value from e where event_type in ('click', 'view') group by key")
def q11_inputs_union_count(spark, d):
    e = events(spark, d)
    a = envelope(e.filter("event_type = 'click'"), "clicks", "key", "offset", "cents")
    b = envelope(e.filter("event_type = 'view'"), "views", "key", "offset", "cents")
    return fold.final_count(union_inputs(a, b))


@query(f"with {E} select key, count(*) as value from e group by key")
def q12_persist_count(spark, d):
    return fold.final_count(events(spark, d))


@query(f'with {E} select key, "offset", count(*) {RUN} as value from e')
def q13_count_changelog(spark, d):
    return events(spark, d).select("key", "offset", fold.running_count(fold.history()).alias("value"))


@query(f"with {E} select key, cast(sum(cents) as bigint) as value from e group by key")
def q14_persist_sum(spark, d):
    return fold.final_sum(events(spark, d), F.col("cents"))


@query(f'with {E} select key, "offset", cast(sum(cents) {RUN} as bigint) as value from e')
def q15_sum_changelog(spark, d):
    return events(spark, d).select("key", "offset", fold.running_sum(F.col("cents"), fold.history()).alias("value"))


@query(f'with {E} select key, event_type, cents from e qualify row_number() over (partition by key order by "offset" desc) = 1')
def q16_persist_last(spark, d):
    return fold.final_last(events(spark, d), "event_type", "cents")


@query(f"with {E}, l as (select * from e qualify row_number() over (partition by key order by \"offset\" desc) = 1) select key, cents as value from l where event_type <> 'error'")
def q17_persist_delete(spark, d):
    return table.compact(changes(events(spark, d)))


@query(f"with {E} select key, \"offset\", string_agg(event_type, ',' order by \"offset\") over (partition by key order by \"offset\" rows between 4 preceding and current row) as last5 from e".replace("string_agg(event_type, ',' order by \"offset\")", "string_agg(event_type, ',')"))
def q18_last_n(spark, d):
    return events(spark, d).select("key", "offset", F.concat_ws(",", fold.running_last_n(F.col("event_type"), 5)).alias("last5"))


@query(f"""with {E}, r as (select *, row_number() over (partition by key order by "offset" desc) as r from e)
select key, string_agg(event_type, ',' order by "offset") as last5 from r where r <= 5 group by key""")
def q18b_last_n_final(spark, d):
    return fold.final_last_n(events(spark, d), F.col("event_type"), 5).select("key", F.concat_ws(",", "value").alias("last5"))


@query(f"with {E} select key, event_type = 'error' as blocked from e where event_type in ('error', 'signup') qualify row_number() over (partition by key order by \"offset\" desc) = 1")
def q19_latch(spark, d):
    return fold.final_latch(events(spark, d), is_error(), F.col("event_type") == "signup").select("key", F.col("value").alias("blocked"))


@query(f"""with {E}, r as (select key, "offset", cast(sum(case when event_type = 'purchase' then 1 else 0 end) {RUN} as bigint) as part,
cast(sum(case when event_type in ('purchase', 'view') then 1 else 0 end) {RUN} as bigint) as whole from e)
select * from r where whole >= 20 and part >= 0.5 * whole""")
def q20_detector_ratio(spark, d):
    e = events(spark, d).select("key", "offset", "event_type")
    bought = F.col("event_type") == "purchase"
    return fold.ratio_alerts(e, bought, bought | (F.col("event_type") == "view"), 20, 0.5).select("key", "offset", "part", "whole")


LOOPED = f"""with {E}, l as (select key, "offset", 0 as hop, event_type from e union all
select cast((cast(key as bigint) * 7 + 3) % 150 as varchar), "offset", 1, event_type from e where event_type = 'purchase')"""


@query(f"""{LOOPED} select key, "offset", hop, cast(sum(1 - hop) over w as bigint) as sent, cast(sum(hop) over w as bigint) as received from l
window w as (partition by key order by "offset", hop rows between unbounded preceding and current row)""")
def q21_detector_loop(spark, d):
    e = events(spark, d).select("key", "offset", "event_type")
    both = loopback(e, (F.col("key").cast("long") * 7 + 3) % 150, F.col("event_type") == "purchase")
    w = fold.history(order=["offset", "hop"])
    return both.select("key", "offset", "hop", fold.running_sum((1 - F.col("hop")).cast("long"), w).alias("sent"), fold.running_sum(F.col("hop").cast("long"), w).alias("received"))


@query(f"""with recursive {E}, r as (select key, "offset", 0 as hop from e union all
select cast((cast(key as bigint) * 7 + 3) % 150 as varchar), "offset", hop + 1 from r where hop < 3)
select key, hop, count(*) as value from r group by key, hop""")
def q22_loop_multihop(spark, d):
    e = events(spark, d).select("key", "offset")
    rows = loop_hops(e, lambda m: m.withColumn("key", ((F.col("key").cast("long") * 7 + 3) % 150).cast("string")), 3)
    return rows.groupBy("key", "hop").agg(F.count(F.lit(1)).alias("value"))


@query(f"with {E} select key, max(cents) as value from e group by key")
def q23_custom_update_cb(spark, d):
    return table.reduce_changelog(events(spark, d), lambda: F.max("cents"))


@query("""with m as (select r_name as member, r_regionkey as k, cast(row_number() over (order by r_name) - 1 as int) as i, cast(count(*) over () as int) as m from region),
s as (select member, i, m, unnest(case when k % 2 = 0 then ['orders'] else ['orders', 'lineitem'] end) as topic from m)
select member, topic, cast(unnest(range(cast(floor(i * 24.0 / m + 0.5) as int), cast(floor((i + 1) * 24.0 / m + 0.5) as int))) as int) as "partition" from s""")
def q24_copartition_plan(spark, d):
    r = read(spark, d, "region")
    topics = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("orders"))).otherwise(F.array(F.lit("orders"), F.lit("lineitem")))
    subscriptions = r.select(F.col("r_name").alias("member"), F.explode(topics).alias("topic"))
    sizes = spark.createDataFrame([("orders", 24), ("lineitem", 24)], "topic string, partitions int")
    return copartition_plan(subscriptions, sizes)


LATEST = f"latest as (select key, cents as value from (select * from e qualify row_number() over (partition by key order by \"offset\" desc) = 1) where event_type <> 'error')"
ORDERS = "o as (select cast(o_custkey as varchar) as key, o_orderkey as \"offset\", cast(round(o_totalprice * 100) as bigint) as cents from orders)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("offset"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query(f'with {E}, {LATEST}, {ORDERS} select o.key, o."offset", o.cents, latest.value as latest from o left join latest on o.key = latest.key')
def q25_join_latest(spark, d):
    t = table.compact(changes(events(spark, d))).withColumnRenamed("value", "latest")
    return joins.join_latest(orders(spark, d), t)


@query(f"""with {E}, {ORDERS}, c as (select key, "offset", case when event_type <> 'error' then cents end as value from e)
select o.key, o."offset", o.cents, c.value as table_value from o asof left join c on o.key = c.key and o."offset" >= c."offset\"""")
def q26_join_asof(spark, d):
    return joins.join_asof(orders(spark, d), changes(events(spark, d)))


FLAGS = "f as (select key, \"offset\", event_type = 'error' as flag from e where event_type in ('error', 'signup'))"


@query(f"""with {E}, {ORDERS}, {FLAGS} select o.key, o."offset", o.cents from o asof left join f on o.key = f.key and o."offset" >= f."offset" where not coalesce(f.flag, false)""")
def q27_join_filter(spark, d):
    e = events(spark, d)
    flags = e.filter("event_type in ('error', 'signup')").select("key", "offset", is_error().alias("flag"))
    return joins.unless(joins.join_asof(orders(spark, d), flags, "flag"), "table_flag").select("key", "offset", "cents")


@query("""select cast(o_custkey as varchar) as key, o_orderkey as "offset", c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def q28_lookup(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    o = joins.lookup(o, c, F.col("o_custkey") == F.col("c_custkey"))
    o = joins.lookup(o, n, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("offset"), "c_name", "n_name")


@query("""select cast(conv_id as varchar) as key, turn as "offset", role, array_to_string(list_transform(string_split(text, ' '), lambda w: case when w in ('the', 'of', 'and') then upper(w) else w end), ' ') as text
from conversations where text is not null and conv_id is not null and turn is not null""")
def q29_lookup_words(spark, d):
    c = read(spark, d, "conversations").filter("text is not null and conv_id is not null and turn is not null")
    c = c.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("offset"), "role", "text")
    words = spark.createDataFrame([(w, w.upper()) for w in ("the", "of", "and")], "word string, value string")
    return joins.lookup_words(c, words, "text", ["key", "offset", "role"], rows=3)


@query(f"""with {E}, c as (select key, "offset", case when event_type <> 'error' then cents end as value from e),
o as (select cast(o_custkey as varchar) as key, o_custkey, o_orderkey as "offset", cast(round(o_totalprice * 100) as bigint) as cents from orders),
j as (select o.*, c.value as table_value from o asof left join c on o.key = c.key and o."offset" >= c."offset"),
n as (select n_name, j.cents from j left join customer on j.o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where j.cents > 1000000 or j.table_value is not null)
select n_name as key, count(*) as orders, cast(sum(cents) as bigint) as cents from n group by n_name""")
def q30_join_and_lookup(spark, d):
    """Decode, as-of join, look up, filter, re-key, fold."""
    o = joins.join_asof(orders(spark, d), changes(events(spark, d))).filter("cents > 1000000 or table_value is not null")
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_key"), "c_nationkey")
    o = joins.lookup(o, c, F.col("key") == F.col("c_key"))
    o = joins.lookup(o, read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("key")).agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))


@query(f"with {E} select key, count(*) as value from e where event_type = 'purchase' and cents > 5000 group by key")
def q31_chain(spark, d):
    """The first processor's output topic is the second's input."""
    return fold.final_count(q07_filter_map(spark, d))


@query(f"with {E}, {LATEST} select key, value from latest where key = '7'")
def q32_view_get(spark, d):
    return TableView(table.compact(changes(events(spark, d)))).get("7")


@query(f"with {E}, {LATEST} select c.key, latest.key is not null as present from (select cast(c_custkey as varchar) as key from customer) c left join latest on c.key = latest.key")
def q32b_view_has(spark, d):
    keys = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return TableView(table.compact(changes(events(spark, d)))).has_keys(keys)


@query(f"with {E}, {LATEST} select key, value from latest order by key")
def q33_view_iterate(spark, d):
    return TableView(table.compact(changes(events(spark, d)))).iterate()


@query(f"with {E}, {LATEST} select key, value from latest where key >= '10' and key < '30' order by key")
def q34_view_range(spark, d):
    return TableView(table.compact(changes(events(spark, d)))).range("10", "30")


@query(f"with {E}, {LATEST} select key, value from latest where starts_with(key, '1') order by key")
def q34b_view_prefix(spark, d):
    return TableView(table.compact(changes(events(spark, d)))).range("1")


@query(f"with {E}, {LATEST} select key, value from latest where key >= '5' order by key")
def q34c_view_seek(spark, d):
    return TableView(table.compact(changes(events(spark, d)))).seek("5")


@query(f"with {E}, {LATEST} select key, value from latest where key not in (select cast(s_suppkey as varchar) from supplier where s_suppkey is not null)")
def q35_view_evict(spark, d):
    gone = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    return TableView(table.compact(changes(events(spark, d)))).evict(gone).table


@query(f"""with {E}, {LATEST}, v as (select key, (select max("offset") from e) // 2 as "offset", 1 as visit, cast(-1 as bigint) as value from latest),
a as (select key, "offset", 0 as visit, case when event_type <> 'error' then cents end as value from e union all select key, "offset", visit, value from v),
l as (select * from a qualify row_number() over (partition by key order by "offset" desc, visit desc) = 1) select key, value from l where value is not null""")
def q36_visitor_reset(spark, d):
    """A visit in the middle of the stream sets every row of the final table to -1; later messages win."""
    log = changes(events(spark, d))
    middle = (log.agg(F.max("offset").alias("o")).first().o or 0) // 2
    visits = table.compact(log).select("key", F.lit(middle).cast("long").alias("offset"), F.lit(-1).cast("long").alias("value"))
    rows = visit.visit_changelog(log, visits).withColumn("at", F.struct("offset", "_visit"))
    return table.compact(rows, order="at")


@query(f'with {E} select key, "offset", cents as value from e where "offset" >= 101 and "offset" < 900')
def q37_recover_from_offset(spark, d):
    return recover_range(events(spark, d).select("key", "offset", F.col("cents").alias("value")), 100, 5, 900)


@query(f"""with {E}, h as (select *, cast({FNV.format(k="key")} as bigint) as hash from e)
select 'events' as topic, cast(abs(case when hash > 2147483647 then hash - 4294967296 else hash end) % 8 as int) as "partition", count(*) as count,
cast(sum(strlen(cast(cents as varchar))) as bigint) as bytes, max("offset") as last_offset from h group by 1, 2""")
def q38_stats(spark, d):
    return stats.input_stats(envelope(events(spark, d), "events", "key", "offset", "cents"))


@query(f"with {E} select key, \"offset\", 'k=' || cast(json_extract(props, '$.k') as varchar) || ',src=replay,type=' || event_type as headers from e")
def q39_headers_merge(spark, d):
    e = events(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    first = F.create_map(F.lit("type"), F.col("event_type"), F.lit("src"), F.lit("events"))
    second = F.create_map(F.lit("src"), F.lit("replay"), F.lit("k"), F.col("k"))
    m = F.array_sort(F.map_entries(headers.merged(first, second)))
    return e.select("key", "offset", F.array_join(F.transform(m, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("headers"))


@query(f"with {E} select key, count(*) as value from e group by key")
def q40_state_count(spark, d):
    """The opaque path: a handler with keyed state, over a batch."""
    e = events(spark, d).select("key", "offset", F.lit(None).cast("binary").alias("value"))
    return run_state(e, count_handler).select("key", F.col("value").cast("long").alias("value"))


@query(f"with {E}, {LATEST}, u as (select key, 1 as value from e where event_type = 'signup' group by key) select coalesce(latest.key, u.key) as key, coalesce(u.value, latest.value) as value from latest full join u on latest.key = u.key")
def q41_table_upsert(spark, d):
    e = events(spark, d)
    base = table.compact(changes(e))
    new = e.filter("event_type = 'signup'").select("key", "offset", F.lit(1).cast("long").alias("value"))
    return table.upsert(base, new)


@query(f"with {E}, {LATEST} select key, -value as value from latest where value <> 0")
def q42_visit_all(spark, d):
    return visit.visit_all(table.compact(changes(events(spark, d))), lambda v: F.when(v != 0, -v))


@query(f"with {E} select topic, count(*) as count, cast(sum(strlen(value)) as bigint) as bytes from (select 'purchases' as topic, cast(cents as varchar) as value from e where event_type = 'purchase' union all select 'large', cast(cents as varchar) from e where cents > 9000) group by topic")
def q43_output_stats(spark, d):
    return stats.output_stats(q09_multi_output(spark, d).withColumn("value", F.encode(F.col("value").cast("string"), "UTF-8")))


@query(f"""with {E}, {FLAGS} select e.key, e."offset", coalesce(f.flag, false) as blocked from e asof left join f on e.key = f.key and e."offset" >= f."offset\"""")
def q44_running_latch(spark, d):
    e = events(spark, d)
    return e.select("key", "offset", F.coalesce(fold.running_latch(is_error(), F.col("event_type") == "signup", fold.history()), F.lit(False)).alias("blocked"))


@query(SQL["q15_sum_changelog"])
def q15b_sum_changelog_in_buckets(spark, d):
    return fold.running_sum_in_buckets(events(spark, d).select("key", "offset", "cents"), F.col("cents"), 1000).select("key", "offset", "value")


@query(SQL["q26_join_asof"])
def q26b_join_asof_in_buckets(spark, d):
    return joins.join_asof_in_buckets(orders(spark, d), changes(events(spark, d)), 1000)


# --- groups, topics and views as they run -----------------------------------


def topic_root(spark: SparkSession) -> TopicManager:
    """Topics of one query, in a folder of their own."""
    return TopicManager(spark, f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}")


def messages(spark: SparkSession, d: str, topic: str = "events") -> DataFrame:
    """Events as envelopes with Int64 cents, null on error."""
    return encoded(envelope(changes(events(spark, d)), topic, "key", "offset", "value"), Int64())


def final_values(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == FINAL).select("key", Int64().decode(F.col("value")).alias("value"))


def hop_on(ctx, left: int) -> None:
    """Counts, and sends what is left of the way to the next key."""
    ctx.set_value((ctx.value() or 0) + 1)
    if left:
        ctx.loopback(str((int(ctx.key) * 7 + 3) % 150), left - 1)


@query("""with recursive r as (select cast(user_id as varchar) as key, event_id % 7 as n from events where event_type = 'signup' and user_id is not null union all
select cast((cast(key as bigint) * 7 + 3) % 150 as varchar), n - 1 from r where n > 0) select key, count(*) as value from r group by key""")
def q45_loop_callbacks(spark, d):
    """Loop-backs of callbacks until none is left."""
    e = events(spark, d).filter("event_type = 'signup' and key is not null").select("key", "offset", (F.col("offset") % 7).alias("way"))
    graph = define_group("hops", Input("in", Int64(), hop_on), Loop(Int64(), hop_on), Persist(Int64()))
    _, table_ = run_until_quiet(graph, encoded(envelope(e, "in", "key", "offset", "way"), Int64()))
    return table_.select("key", Int64().decode(F.col("value")).alias("value"))


@query(f"""with {E}, h as (select key, "offset", case when event_type <> 'error' then cents end as value, cast({FNV.format(k="key")} as bigint) as hash from e),
p as (select *, cast(abs(case when hash > 2147483647 then hash - 4294967296 else hash end) % 8 as int) as "partition", strlen(key) + coalesce(strlen(cast(value as varchar)), 0) as size from h)
select 'events' as topic, "partition", count(*) filter (where "offset" < 500) as count, cast(coalesce(sum(size) filter (where "offset" < 500), 0) as bigint) as bytes,
coalesce(max("offset") filter (where "offset" < 500), -1) as last_offset, max("offset") + 1 as hwm, count(*) filter (where "offset" >= 500) as lag, count(*) filter (where "offset" >= 500) = 0 as recovered from p group by "partition\"""")
def q46_recovery_stats(spark, d):
    return stats.recovery_stats(messages(spark, d), F.lit(500))


def nothing(ctx, message) -> None:
    pass


@query("""select * from (values ('Input', 'clicks', true), ('Input', 'views', true), ('Loop', 'shop-again', false), ('Persist', 'shop-state', false), ('Join', 'limits', true), ('Lookup', 'names', false), ('Output', 'alerts', false), ('Visitor', 'reset', false)) t(kind, topic, copartitioned)""")
def q47_group_graph(spark, d):
    """A group's edges under its own suffixes, and which of them must be co-partitioned."""
    edges = [inputs(["clicks", "views"], Int64(), nothing), Loop(Int64(), nothing), Persist(Int64()), Join("limits", Int64()), Lookup("names", Int64()), Output("alerts", Int64()), Visitor("reset", nothing)]
    g = define_group("shop", *edges, table_suffix="-state", loop_suffix="-again").validate()
    found = [*g.input_streams, g.loop_stream, g.group_table, *g.joint_tables, *g.lookup_tables, *g.output_streams, *g.visitors]
    return spark.createDataFrame([(type(e).__name__, e.topic, e.topic in g.copartitioned()) for e in found], "kind string, topic string, copartitioned boolean")


@query("""with m as (select r_name as member, cast(row_number() over (order by r_name) - 1 as int) as i, cast(count(*) over () as int) as m from region)
select member, unnest(['lineitem', 'orders']) as topic, "partition" from (select member, cast(unnest(range(cast(floor(i * 24.0 / m + 0.5) as int), cast(floor((i + 1) * 24.0 / m + 0.5) as int))) as int) as "partition" from m)""")
def q48_strict_plan(spark, d):
    subscriptions = read(spark, d, "region").select(F.col("r_name").alias("member"), F.explode(F.array(F.lit("orders"), F.lit("lineitem"))).alias("topic"))
    return copartition_plan(subscriptions, spark.createDataFrame([("orders", 24), ("lineitem", 24)], "topic string, partitions int"), strict=True)


@query(f"with {E} select key, \"offset\", 'src=replay,type=' || event_type as headers from e")
def q49_header_pairs(spark, d):
    """Headers as a source delivers them: of repeated names the last stays."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pairs = F.array(pair("src", F.lit("events")), pair("type", F.col("event_type")), pair("src", F.lit("replay")))
    back = F.array_sort(headers.to_pairs(headers.from_pairs(pairs)))
    return events(spark, d).select("key", "offset", F.array_join(F.transform(back, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("headers"))


def forward(ctx, cents: int) -> None:
    ctx.emit("out", ctx.key, cents, {"from": ctx.topic.encode(), "partition": str(ctx.partition).encode()})


@query(f"""with {E}, h as (select *, cast({FNV.format(k="key")} as bigint) as hash from e where event_type <> 'error')
select key, "offset", cents as value, 'app=q50,from=events,partition=' || cast(abs(case when hash > 2147483647 then hash - 4294967296 else hash end) % 8 as varchar) as headers from h""")
def q50_emit_headers(spark, d):
    """A stateless group that emits with default headers, its own and the message's partition."""
    graph = define_group("forward", Input("events", Int64(), forward), Output("out", Int64()))
    out = run_batch(graph, messages(spark, d), ProcessorOptions(default_headers={"app": b"q50", "from": b"nobody"}))
    pairs = F.array_sort(F.map_entries("headers"))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), F.decode(x["value"], "UTF-8"))), ",")
    return out.filter(F.col("kind") == OUTPUT).select("key", "offset", Int64().decode(F.col("value")).alias("value"), text.alias("headers"))


class OneMore:
    """A context of one's own: what is set becomes one more."""

    def __init__(self, ctx):
        self.ctx = ctx

    def set_value(self, value: int) -> None:
        self.ctx.set_value(value + 1)


def keep(ctx, cents: int) -> None:
    ctx.set_value(cents)


@query(f"with {E} select key, cents + 1 as value from e where event_type <> 'error' qualify row_number() over (partition by key order by \"offset\" desc) = 1")
def q51_context_wrapper(spark, d):
    graph = define_group("wrapped", Input("events", Int64(), keep), Persist(Int64()))
    return final_values(run_batch(graph, messages(spark, d), ProcessorOptions(context_wrapper=OneMore)))


def add_limit(ctx, meta: str) -> None:
    ctx.set_value(ctx.value() + (ctx.join("limits") or 0) + int(meta))


@query(f"""with {E}, {LATEST}, l as (select cast(c_custkey as varchar) as key, c_nationkey as n from customer)
select latest.key, latest.value + coalesce(l.n, 0) + 1000 as value from latest left join l on latest.key = l.key""")
def q52_join_in_visit(spark, d):
    """A visitor that joins a table: every row of the group table grows by its limit and 1000."""
    graph = define_group("limited", Input("events", Int64(), nothing), Persist(Int64()), Join("limits", Int64()), Visitor("grow", add_limit))
    limits = read(spark, d, "customer").select(F.lit("limits").alias("topic"), F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("offset"), F.col("c_nationkey").cast("long").alias("value"))
    preset = encoded(table.compact(changes(events(spark, d))), Int64())
    visits = preset.select(F.lit("grow").alias("topic"), "key", F.lit(1).alias("offset"), F.encode(F.lit("1000"), "UTF-8").alias("value"))
    none = messages(spark, d).limit(0)
    return final_values(run_batch(graph, none, table=preset, join_changes=encoded(limits, Int64()), visits=visits))


@query(f"with {E}, {LATEST} select key, value from latest")
def q53_view_follow(spark, d):
    """A view that takes later changes in without reading the earlier ones again."""
    topics, log = topic_root(spark), messages(spark, d).withColumn("seq", F.col("offset"))
    topics.ensure_table_exists("state", 8)
    topics.append("state", log.filter("offset < 4000"))
    view = View(topics, "state", Int64()).run()
    topics.append("state", log.filter("offset >= 4000 and offset < 5000"))
    view.refresh()
    topics.append("state", log.filter("offset >= 5000"))
    return view.refresh().table()


@query(f"with {E} select key, cents as value from (select key, case when event_type <> 'error' then cents end as cents from e qualify row_number() over (partition by key order by \"offset\" desc) = 1)")
def q54_topic_compaction(spark, d):
    """A table's topic after compaction: the last change of every key, deletions included."""
    topics, log = topic_root(spark), messages(spark, d).withColumn("seq", F.col("offset"))
    topics.ensure_table_exists("state", 8)
    topics.append("state", log.filter("offset < 5000"))
    topics.append("state", log.filter("offset >= 5000"))
    topics.compact("state")
    return topics.read("state").select("key", Int64().decode(F.col("value")).alias("value"))


@query(f"with {E} select key, count(*) as value from e where event_type <> 'error' group by key")
def q55_stream_processor(spark, d):
    """A processor over a topic, by micro-batches through the state store; its table as the store has it."""
    topics = topic_root(spark)
    topics.ensure_stream_exists("events", 8)
    topics.append("events", messages(spark, d).withColumn("seq", F.col("offset")))
    graph = define_group("counting", Input("events", Int64(), count_handler), Persist(Int64()))
    return StreamProcessor(graph, topics, f"{topics.root}/checkpoint").run_available().table()


@query("""select * from (values ('clicks', 4, 'delete', '3600000'), ('state', 4, 'compact', null)) t(topic, partitions, policy, retention)""")
def q56_topic_catalogue(spark, d):
    topics = topic_root(spark)
    topics.ensure_stream_exists("clicks", 4)
    topics.ensure_table_exists("state", 4)
    topics.ensure_copartitioned(["clicks", "state"])
    found = [(t, len(topics.partitions(t)), topics.config(t)["config"]) for t in ("clicks", "state")]
    return spark.createDataFrame([(t, n, c["cleanup.policy"], c.get("retention.ms")) for t, n, c in found], "topic string, partitions int, policy string, retention string")


@query(f"with {E} select cast(cents as varchar) as value from e where event_type <> 'error'")
def q57_append_storage(spark, d):
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    append_text(messages(spark, d).filter("value is not null"), path)
    return spark.read.text(path)


@query(f"""with {E}, h as (select *, cast({FNV.format(k="key")} as bigint) as hash from e)
select 'events' as topic, cast(abs(case when hash > 2147483647 then hash - 4294967296 else hash end) % 8 as int) as "partition", count(*) as count, cast(sum(strlen(cast(cents as varchar))) as bigint) as bytes,
max("offset") as last_offset, epoch(timestamp '2100-01-01') - epoch(max("timestamp")) as delay from h group by 1, 2""")
def q58_input_delay(spark, d):
    e = envelope(events(spark, d), "events", "key", "offset", "cents", "timestamp")
    return stats.input_stats(e, now=F.lit("2100-01-01").cast("timestamp"))


def most(topic: str, key: str, old: bytes | None, new: bytes | None) -> bytes | None:
    """A joined table that keeps the largest value it ever had; deletions don't count."""
    return old if new is None or (old is not None and int(old) >= int(new)) else new


def emit_limit(ctx, cents: int) -> None:
    ctx.emit("out", ctx.key, ctx.join("limits") or -1)


@query(f"""with {E}, {ORDERS}, c as (select key, "offset", max(case when event_type <> 'error' then cents end) {RUN} as value from e)
select o.key, o."offset", coalesce(c.value, -1) as value from o asof left join c on o.key = c.key and o."offset" >= c."offset\"""")
def q59_update_callback(spark, d):
    """Changes of a joined table pass the group's own update function before they are seen."""
    graph = define_group("limits", Input("orders", Int64(), emit_limit), Join("limits", Int64()), Output("out", Int64()))
    stream = encoded(envelope(orders(spark, d), "orders", "key", "offset", "cents"), Int64())
    out = run_batch(graph, stream, ProcessorOptions(update_callback=most), join_changes=messages(spark, d, "limits"))
    return out.filter(F.col("kind") == OUTPUT).select("key", "offset", Int64().decode(F.col("value")).alias("value"))


@query(f'with {E} select key, cast(length(key) % 4 as int) as "partition" from e')
def q60_custom_hasher(spark, d):
    """Messages appended under a hash of one's own."""
    topics = topic_root(spark)
    topics.ensure_stream_exists("events", 4)
    topics.append("events", messages(spark, d), hasher=lambda k: F.length(k).cast("long"))
    return topics.read("events").select("key", "partition")
