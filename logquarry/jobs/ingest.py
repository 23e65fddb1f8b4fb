"""Queries: reading, routing and upkeep of senders and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs.query import EV_SQL, HOSTS_SQL, LINES_SQL, at_literal, host_table, log_events, micros, query, raw_lines, table
from logquarry.operators import ingest as op
from logquarry.sources import records as src
from logquarry.sources import sinks
from logquarry.sources.batches import BatchStore


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events as input records: parsed where value is 20 or more, with a parser for four of five."""
    ev = log_events(spark, d)
    return ev.select(
        "event_id", "source", F.col("action").alias("raw"), F.col("at").alias("received_at"),
        F.when(F.col("value") >= 20, F.to_json(F.struct("port"))).alias("ecs"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("p1").alias("parser_id"),
        F.when(F.col("value") >= 20, F.col("value") * 10).alias("skew"),
    )


REC_SQL = f"""{EV_SQL}, {HOSTS_SQL}, routed as (
    select event_id, source, us, action, coalesce(status, 'pending') as status, case when value >= 20 then value * 10 end as skew,
        case when coalesce(status, 'pending') = 'rejected' then 'dropped'
            when coalesce(status, 'pending') = 'approved' and value >= 20 and event_id % 5 <> 0 then 'event' else 'quarantine' end as route,
        coalesce(status, 'pending') not in ('rejected', 'approved') as held
    from ev left join hosts using (source)
)"""


def routed(spark: SparkSession, d: str) -> DataFrame:
    return op.route_records(records(spark, d), host_table(spark, d))


@query(f"with {REC_SQL} select event_id, source, status, route, held from routed")
def q_route_records(spark, d):
    return routed(spark, d).select("event_id", "source", "status", "route", "held")


@query(f"""with {REC_SQL} select count(*) filter (route = 'event') as events, count(*) filter (route = 'quarantine' and not held) as unparsed,
    count(*) filter (held) as held, count(*) filter (route = 'dropped') as dropped from routed""")
def q_route_counts(spark, d):
    return op.route_counts(routed(spark, d))


@query("""select event_id, 's' || (user_id % 10) as source, event_type as raw, epoch_us(ts) as received_us, props as ecs, 'p' || (user_id % 3) as parser_id
    from events where event_id % 11 <> 0""")
def q_read_ndjson(spark, d):
    """Envelopes written as JSON lines, every eleventh broken and every seventh an array, and read back."""
    ev = log_events(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")
    doc = F.to_json(F.struct(F.col("action").alias("message"), "source", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.from_json("props", "struct<k:int>").alias("ecs"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("parser_id")))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(doc, F.lit("x"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    got, _ = src.read_ndjson(ev.select("event_id", line.alias("value")))
    props = F.concat(F.lit('{"k": '), F.get_json_object("ecs", "$.k"), F.lit("}"))
    return got.select("event_id", "source", "raw", micros("received_at").alias("received_us"), props.alias("ecs"), "parser_id")


@query(f"with {LINES_SQL} select doc_id, line_no, md5(line) as digest from lines")
def q_read_lines(spark, d):
    return raw_lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


@query("""select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as line_no, event_type || ' ' || event_id as raw, event_type as action
    from (select * from events where event_id % 4 <> 0)""")
def q_read_fixture_docs(spark, d):
    """Labelled documents of each user as one JSON text, read back; those without a line are dropped."""
    ev = log_events(spark, d)
    line = F.when(F.col("event_id") % 4 != 0, F.concat_ws(" ", "action", F.col("event_id").cast("string")))
    doc = F.struct(F.col("event_id").alias("id"), F.struct(line.alias("original"), "action").alias("event"))
    text = F.to_json(F.struct(F.array_sort(F.collect_list(doc)).alias("expected")))
    got = src.read_fixture_docs(ev.groupBy("user_id").agg(text.alias("text")), "text", "struct<id: bigint, event: struct<original: string, action: string>>")
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("line_no")) - 1).cast("long")
    return got.select("user_id", place.alias("line_no"), "raw", F.col("expected.event.action").alias("action"))


RESULTS_SQL = "select p_partkey as run, p_brand as model, p_size as attempts, round(p_retailprice / 3000, 6) as f1, p_size % 3 = 0 as passed from part"


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("run"), F.col("p_brand").alias("model"), F.col("p_size").alias("attempts"),
        F.round(F.col("p_retailprice") / 3000, 6).alias("f1"), (F.col("p_size") % 3 == 0).alias("passed"),
    )


@query(RESULTS_SQL)
def q_read_jsonl_results(spark, d):
    rows, path = results(spark, d), sinks.scratch_path(spark, "results")
    sinks.append_results(rows, path)
    return src.read_jsonl_results(spark, path, "run long, model string, attempts int, f1 double, passed boolean")


@query(f"select * from ({RESULTS_SQL}) where attempts < 10 union all select * from ({RESULTS_SQL}) where attempts >= 40")
def q_append_results(spark, d):
    rows, path = results(spark, d), sinks.scratch_path(spark, "results")
    sinks.append_results(rows.where("attempts < 10"), path)
    sinks.append_results(rows.where("attempts >= 40"), path)
    return src.read_jsonl_results(spark, path, "run long, model string, attempts int, f1 double, passed boolean")


def _written(spark, d, rows: DataFrame) -> DataFrame:
    path = sinks.scratch_path(spark, "rows")
    sinks.write_by_date(rows.select("event_id", "source", "raw", "received_at"), path)
    got = spark.read.option("basePath", path).schema("event_id long, source string, raw string, received_at timestamp, event_date string").parquet(path)
    return got.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"with {REC_SQL} select strftime(make_timestamp(us), '%Y-%m-%d') as event_date, count(*) as n, sum(event_id)::bigint as ids from routed where route = 'event' group by 1")
def q_write_events(spark, d):
    return _written(spark, d, routed(spark, d).where("route = 'event'"))


@query(f"with {REC_SQL} select strftime(make_timestamp(us), '%Y-%m-%d') as event_date, count(*) as n, sum(event_id)::bigint as ids from routed where route = 'quarantine' group by 1")
def q_write_quarantine(spark, d):
    return _written(spark, d, routed(spark, d).where("route = 'quarantine'"))


HOSTS0_SQL = "known as (select source, status, us0 as first_us, us0 as last_us, 5 as n from (select *, 1704067200000000 as us0 from hosts))"


def known_hosts(spark, d):
    start = at_literal("2024-01-01 00:00:00")
    return host_table(spark, d).select("source", "status", start.alias("first_seen"), start.alias("last_seen"), F.lit(5).cast("long").alias("lines"))


@query(f"""with {EV_SQL}, {HOSTS_SQL}, {HOSTS0_SQL}, new as (select source, min(us) as a, max(us) as b, count(*) as c from ev group by source)
    select coalesce(k.source, w.source) as source, coalesce(status, 'pending') as status, coalesce(first_us, a) as first_us, greatest(last_us, b) as last_us,
        coalesce(n, 0) + coalesce(c, 0) as lines from known k full join new w on k.source = w.source""")
def q_upsert_hosts(spark, d):
    out = op.upsert_hosts(known_hosts(spark, d), records(spark, d))
    return out.select("source", "status", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "lines")


def quarantine(spark, d):
    return routed(spark, d).where("route = 'quarantine'").select(F.col("event_id").alias("line_id"), "source", "received_at", "raw", "held")


def decisions(spark, d, status):
    return host_table(spark, d).where("status = 'pending'").select("source", F.lit(status).alias("status"))


Q_SQL = f"{REC_SQL}, quarantine as (select event_id as line_id, source, us, action as raw, held from routed where route = 'quarantine'), decided as (select source from hosts where status = 'pending')"


@query(f"with {Q_SQL} select line_id, q.source, held and d.source is null as held from quarantine q left join decided d on d.source = q.source")
def q_approve_host(spark, d):
    return op.release_or_drop(quarantine(spark, d), decisions(spark, d, "approved")).select("line_id", "source", "held")


@query(f"with {Q_SQL} select line_id, q.source, held from quarantine q left join decided d on d.source = q.source where not (held and d.source is not null)")
def q_reject_host(spark, d):
    return op.release_or_drop(quarantine(spark, d), decisions(spark, d, "rejected")).select("line_id", "source", "held")


@query("""with h as (select c_custkey as id, 's' || c_custkey as source, c_acctbal from customer)
    select source, case when id % 3 = 0 then null when c_acctbal >= 0 then c_acctbal else 10.0 end as silence_min_minutes,
        case when id % 2 = 0 then 3.0 else 2.0 end as silence_factor, false as has_other from h""")
def q_set_thresholds(spark, d):
    """Overrides 10 and 2; changes remove the first for every third sender and set it to an amount if that
    is not negative, set the second to 3 for every other sender, and try an unknown key."""
    cust = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source"), "c_acctbal")
    hosts = cust.select("source", F.create_map(F.lit("silence_min_minutes"), F.lit(10.0), F.lit("silence_factor"), F.lit(2.0)).alias("thresholds"))
    first = F.create_map(F.lit("silence_min_minutes"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), F.lit("other"), F.lit(1.0))
    second = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("silence_factor"), F.lit(3.0))).otherwise(F.expr("cast(map() as map<string,double>)"))
    out = op.set_thresholds(hosts, cust.select("source", F.map_concat(first, second).alias("values")))
    th = F.col("thresholds")
    return out.select("source", th["silence_min_minutes"].alias("silence_min_minutes"), th["silence_factor"].alias("silence_factor"), F.map_contains_key(th, "other").alias("has_other"))


BACK_SQL = f"""{Q_SQL}, tried as (select *, row_number() over (partition by source order by line_id) as n from quarantine where not held),
    done as (select * from tried where n <= 200 and raw in ('click', 'view'))"""


@query(f"with {BACK_SQL} select line_id, source, 'doc:' || raw as doc, true as moved from done union all select line_id, source, null, false from quarantine where line_id not in (select line_id from done)")
def q_backfill(spark, d):
    q = quarantine(spark, d)
    parsed = q.select("line_id", F.when(F.col("raw").isin("click", "view"), F.concat(F.lit("doc:"), "raw")).alias("doc"))
    done, rest = op.backfill(q, parsed, 200)
    none = F.lit(None).cast("string")
    return done.select("line_id", "source", "doc", F.lit(True).alias("moved")).unionByName(rest.select("line_id", "source", none.alias("doc"), F.lit(False).alias("moved")))


@query(f"""with {BACK_SQL}, gained as (select source, (us // 60000000) * 60000000 as minute_us, count(*) as n, coalesce(sum(case when line_id % 3 = 0 then (line_id % 100) / 4 end), 0) as s, count(case when line_id % 3 = 0 then 1 end) as k from done group by 1, 2),
    counters as (select source, (us // 60000000) * 60000000 as minute_us, count(*) as total, count(*) filter (route = 'event') as parsed, coalesce(sum(skew), 0) as skew_sum, count(skew) as skew_n from routed where route <> 'dropped' group by 1, 2)
    select source, minute_us, total, parsed + coalesce(n, 0) as parsed, round(skew_sum + coalesce(s, 0), 4) as skew_sum, skew_n + coalesce(k, 0) as skew_n from counters left join gained using (source, minute_us)""")
def q_backfill_counters(spark, d):
    """Minute counters after a backfill in two runs, of which the second is tried twice; a third of the lines has a time of its own."""
    q = quarantine(spark, d)
    own = F.when(F.col("line_id") % 3 == 0, F.timestamp_micros(micros("received_at") - (F.col("line_id") % 100) * 250_000))
    parsed = q.select("line_id", F.when(F.col("raw").isin("click", "view"), F.concat(F.lit("doc:"), "raw")).alias("doc"), own.alias("event_at"))
    store = BatchStore(spark, sinks.scratch_path(spark, "backfill"))
    first = q.join(op.backfill(q, parsed, 200)[0].select("line_id"), "line_id", "left_semi")  # both runs together try the oldest 200
    for run, tried in ((0, first.where("raw = 'click'")), (1, first), (1, first)):
        op.run_backfill(store, run, tried, parsed)
    out = op.mend_counters(op.minute_stats(routed(spark, d)), op.merge_counters(store.read("counters", op.GAINED)))
    return out.select("source", micros("minute").alias("minute_us"), "total", "parsed", F.round("skew_sum", 4).alias("skew_sum"), "skew_n")


@query("""select p_partkey as parser_id, p_brand as source, case when p_size % 2 = 1 then 'proposed'
    when row_number() over (partition by p_brand, p_size % 2 order by p_size desc, p_partkey desc) > 1 then 'superseded' else 'approved' end as status from part""")
def q_activate_parser(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("parser_id"), F.col("p_brand").alias("source"),
        F.when(F.col("p_size") % 2 == 1, "proposed").otherwise("approved").alias("status"), F.col("p_size").alias("decided_at"))
    return op.activate_parser(p).select("parser_id", "source", "status")


@query(f"with {Q_SQL} select source, count(*) as n, min(us) as first_us, max(us) as last_us from quarantine where not held group by source")
def q_quarantine_stats(spark, d):
    return op.quarantine_stats(quarantine(spark, d)).select("source", "n", micros("first").alias("first_us"), micros("last").alias("last_us"))


@query(f"with {Q_SQL} select line_id, source, raw from quarantine where not held order by line_id desc limit 500")
def q_quarantine_latest(spark, d):
    return op.newest(quarantine(spark, d).where("not held"), 500, "line_id").select("line_id", "source", "raw")


@query(f"with {Q_SQL} select line_id, source, raw from (select *, row_number() over (partition by source order by line_id desc) as n from quarantine where held) where n <= 10")
def q_held_sample(spark, d):
    return op.newest_by(quarantine(spark, d).where("held"), 10, "line_id", "source").select("line_id", "source", "raw")


@query(f"with {Q_SQL} select line_id, source, raw from quarantine where not held order by line_id limit 5000")
def q_quarantine_oldest(spark, d):
    return op.newest(quarantine(spark, d).where("not held"), 5000, "line_id", descending=False).select("line_id", "source", "raw")


@query(f"with {HOSTS_SQL} select source, status, 30.0::double as silence_min_minutes from hosts where status = 'approved'")
def q_hosts_list(spark, d):
    hosts = known_hosts(spark, d).withColumn("thresholds", F.lit('{"silence_min_minutes": 30}'))
    return op.hosts_list(hosts, "approved").select("source", "status", F.col("thresholds")["silence_min_minutes"].alias("silence_min_minutes"))


@query(f"with {EV_SQL} select event_id, source, action from ev where source = 's3' order by event_id desc limit 100")
def q_latest_events(spark, d):
    return op.newest(log_events(spark, d).where("source = 's3'"), 100, "event_id").select("event_id", "source", "action")


@query(f"""with {Q_SQL}, both_ as (select 0 as kind, line_id as id, raw from (select * from quarantine where source = 's3' order by line_id desc limit 1500)
    union all select 1, event_id, action from (select * from routed where source = 's3' and route = 'event' order by event_id desc limit 1500))
    select kind, id, raw from both_ order by kind, id desc limit 1500""")
def q_recent_raw(spark, d):
    ev = routed(spark, d).where("source = 's3' and route = 'event'").select("event_id", "raw")
    return op.recent_raw(quarantine(spark, d).where("source = 's3'"), ev, 1500)


@query(f"""with {EV_SQL}, latest as (select * from ev order by event_id desc limit 2000)
    select event_id, source, action from (select *, row_number() over (partition by source order by event_id desc) as n from latest) where n = 1 order by event_id desc limit 6""")
def q_context_events(spark, d):
    return op.context_events(log_events(spark, d)).select("event_id", "source", "action")


@query(f"""with {Q_SQL} select 'hosts:' || status as what, count(*) as n from hosts group by 1
    union all select 'parsers:' || case when p_size % 2 = 1 then 'proposed' else 'approved' end, count(*) from part group by 1
    union all select 'events', count(*) from routed where route = 'event' union all select 'quarantined', count(*) from quarantine where not held
    union all select 'held', count(*) from quarantine where held""")
def q_summary(spark, d):
    parsers = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 1, "proposed").otherwise("approved").alias("status"))
    return op.summary(host_table(spark, d), routed(spark, d).where("route = 'event'"), quarantine(spark, d), parsers)


SKEW_SQL = """docs as (select event_id, epoch_us(ts) as us, case when event_id % 3 = 0 then 'soon' when event_id % 3 = 1 then null else 'x' end as kind from events)"""


def _doc_times(spark, d):
    """Documents' own times: none, unreadable, or a minute and event_id % 1000 milliseconds earlier."""
    ev = log_events(spark, d)
    own = F.timestamp_micros(micros("at") - 60_000_000 - (F.col("event_id") % 1000) * 1000)
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(own, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).when(F.col("event_id") % 3 == 2, "yesterday")
    return ev.select("event_id", "at", text.alias("text"))


@query("select event_id, case when event_id % 3 = 0 then round((60000000 + (event_id % 1000) * 1000) / 1e6, 6) end as skew from events")
def q_clock_skew(spark, d):
    return _doc_times(spark, d).select("event_id", F.round(op.clock_skew(F.try_to_timestamp("text"), F.col("at")), 6).alias("skew"))


@query("select event_id, case when event_id % 3 = 0 then epoch_us(ts) - 60000000 - (event_id % 1000) * 1000 else epoch_us(ts) end as us from events")
def q_event_time(spark, d):
    return _doc_times(spark, d).select("event_id", micros(op.event_time(F.col("text"), F.col("at"))).alias("us"))


@query(f"""with {REC_SQL} select source, (us // 60000000) * 60000000 as minute_us, count(*) as total, count(*) filter (route = 'event') as parsed,
    round(coalesce(sum(skew), 0), 4) as skew_sum, count(skew) as skew_n from routed where route <> 'dropped' group by 1, 2""")
def q_minute_stats(spark, d):
    out = op.minute_stats(routed(spark, d))
    return out.select("source", micros("minute").alias("minute_us"), "total", "parsed", F.round("skew_sum", 4).alias("skew_sum"), "skew_n")
