"""Queries: streams over the events table, run to its end and read back; their SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs import alerting, ingest
from logquarry.jobs import rules as rq
from logquarry.jobs.detection import MATCH_SQL
from logquarry.jobs.query import EV_SQL, LINES_SQL, host_table, instant, micros, query, table
from logquarry.operators import ingest as ingest_op
from logquarry.sources.batches import BatchStore
from logquarry.sources.sinks import scratch_path
from logquarry.streaming import jobs as op


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of files, with the columns that log_events() has."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(
        "event_id", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"), "user_id", F.col("event_type").alias("action"),
        instant("ts").alias("at"), "value", F.get_json_object("props", "$.k").alias("port"),
    )


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    return op.run_once(stream, scratch_path(spark, "stream"), mode)


def record_stream(spark, d) -> DataFrame:
    return event_stream(spark, d).select(
        "event_id", "source", F.col("action").alias("raw"), F.col("at").alias("received_at"), F.when(F.col("value") >= 20, F.to_json(F.struct("port"))).alias("ecs"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("p1").alias("parser_id"), F.when(F.col("value") >= 20, F.col("value") * 10).alias("skew"),
    )


def routed_stream(spark, d) -> DataFrame:
    return op.route_stream(record_stream(spark, d), host_table(spark, d))


@query(f"with {ingest.REC_SQL} select event_id, route, held from routed")
def q_stream_route(spark, d):
    return _ran(spark, routed_stream(spark, d)).select("event_id", "route", "held")


@query(f"""with {ingest.REC_SQL}, minutes as (select source, count(distinct us // 60000000) as minutes, count(*) as total, count(*) filter (route = 'event') as parsed, round(coalesce(sum(skew), 0), 4) as skew_sum from routed where route <> 'dropped' group by 1)
    select r.source, count(*) filter (route = 'event') as events, count(*) filter (route = 'quarantine') as quarantined, count(*) filter (held) as held, coalesce(sum(event_id) filter (route <> 'dropped'), 0)::bigint as ids,
        count(*) as lines, min(us) as first_us, max(us) as last_us, min(status) as status, coalesce(any_value(minutes), 0) as minutes, coalesce(any_value(total), 0) as total, coalesce(any_value(parsed), 0) as parsed, coalesce(any_value(skew_sum), 0) as skew_sum
    from routed r left join minutes m on m.source = r.source group by r.source""")
def q_stream_sinks(spark, d):
    """A stream routed into events, quarantine, senders and minute counters, a batch at a time, by sender."""
    path = scratch_path(spark, "sinks")
    store = BatchStore(spark, path)
    op.route_to(record_stream(spark, d), host_table(spark, d), store, f"{path}/checkpoint", key="event_id")
    of = lambda route: F.count_if(F.col("route") == route)
    lines = op.routed_lines(store, "event_id long").groupBy("source").agg(of("event").alias("events"), of("quarantine").alias("quarantined"), F.count_if("held").alias("held"), F.sum("event_id").alias("ids"))
    none = spark.createDataFrame([], op.HOST_GAINS)
    known = host_table(spark, d).join(none.drop("status"), "source", "left")
    hosts = op.host_gains(store, known).where("lines > 0").select("source", "status", "lines", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"))
    merged = ingest_op.merge_counters(store.read("counters", op.COUNTER_GAINS)).groupBy("source").agg(
        F.count(F.lit(1)).alias("minutes"), F.sum("total").alias("total"), F.sum("parsed").alias("parsed"), F.round(F.sum("skew_sum"), 4).alias("skew_sum")
    )
    filled = {c: 0 for c in ("events", "quarantined", "held", "ids", "minutes", "total", "parsed", "skew_sum")}
    return hosts.join(lines, "source", "left").join(merged, "source", "left").fillna(filled)


@query(f"""with {ingest.REC_SQL} select source, (us // 60000000) * 60000000 as minute_us, count(*) as total, count(*) filter (route = 'event') as parsed, round(coalesce(sum(skew), 0), 4) as skew_sum, count(skew) as skew_n from routed where route <> 'dropped' group by 1, 2""")
def q_stream_minute_stats(spark, d):
    rows = op.latest(_ran(spark, op.minute_stats_stream(routed_stream(spark, d)), "update"), ["source", "minute"])
    return rows.select("source", micros("minute").alias("minute_us"), "total", "parsed", F.round("skew_sum", 4).alias("skew_sum"), "skew_n")


@query(f"with {MATCH_SQL} select rule_id, event_id from matches where rule_id in ('failure', 'purchase')")
def q_stream_matches(spark, d):
    rules = [r for r in rq.compiled() if r.id in ("failure", "purchase")]
    return _ran(spark, op.matches_stream(event_stream(spark, d), rules)).select("rule_id", "event_id")


@query(f"""with {EV_SQL}, m as (select * from ev where action = 'error') select e.event_id, e.source, e.user_id, count(*) as n from m e join m p on p.source = e.source and p.user_id = e.user_id and p.event_id <= e.event_id
    and p.us between e.us - 86400000000 and e.us group by all having count(*) >= 2""")
def q_stream_correlation(spark, d):
    failures = event_stream(spark, d).where("action = 'error'").select("event_id", "source", "user_id", "at")
    path = scratch_path(spark, "correlated")
    store = BatchStore(spark, path)
    op.correlate_to(failures, ["user_id"], 86_400, store, f"{path}/checkpoint")
    return op.correlated(store, failures, ["user_id"]).where("n >= 2").select("event_id", "source", "user_id", "n")


@query(f"""with {EV_SQL}, m as (select *, coalesce(case when event_id % 9 <> 0 then port end, 'none') as v from ev where action <> 'view') select e.event_id, e.source, e.user_id, count(distinct p.v) as n
    from m e join m p on p.source = e.source and p.user_id = e.user_id and p.event_id <= e.event_id and p.us between e.us - 86400000000 and e.us group by all having count(distinct p.v) >= 2""")
def q_stream_value_correlation(spark, d):
    rows = event_stream(spark, d).where("action <> 'view'").select("event_id", "source", "user_id", "at", F.when(F.col("event_id") % 9 != 0, F.col("port")).alias("port"))
    return _ran(spark, op.correlation_stream(rows, ["user_id"], 86_400, field="port"), "update").where("n >= 2").select("event_id", "source", "user_id", "n")


SESSION_SQL = f"""{alerting.HITS_SQL}, marked as (select *, case when us - 86400000000 > lag(us) over w or lag(us) over w is null then 1 else 0 end as fresh from hits window w as (partition by source, user_id order by us)),
    islands as (select *, sum(fresh) over (partition by source, user_id order by us, event_id) as no from marked) select source, user_id, min(us) as first_us, max(us) as last_us, count(*) as n from islands group by source, user_id, no"""


@query(f"with {SESSION_SQL}")
def q_stream_alert_dedup(spark, d):
    hits = event_stream(spark, d).where("action = 'error'").select(F.lit("rule").alias("kind"), F.lit("failure").alias("rule_id"), "source", F.col("user_id").cast("string").alias("group_key"), "at")
    rows = _ran(spark, op.alert_stream(hits, 1440), "complete")
    return rows.select("source", F.col("group_key").cast("long").alias("user_id"), micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), F.col("count").alias("n"))


CLOSED_SQL = f"""{alerting.HITS_SQL}, marks as (select source, user_id, event_id, us, 0 as ends from hits union all select source, user_id, event_id, null, 1 from ev where event_id % 11 = 0),
    eras as (select *, sum(ends) over (partition by source, user_id order by event_id, ends) as era from marks),
    marked as (select *, case when us - 86400000000 > max(us) over w or max(us) over w is null then 1 else 0 end as fresh from eras where ends = 0 window w as (partition by source, user_id, era order by event_id rows between unbounded preceding and 1 preceding)),
    islands as (select *, sum(fresh) over (partition by source, user_id order by event_id) as alert_no from marked)"""


@query(f"""with {CLOSED_SQL} select source, user_id, alert_no::bigint as alert_no, min(us) as first_us, max(us) as last_us, count(*) as n, min(event_id) as first_event from islands group by 1, 2, 3""")
def q_stream_alert_fold(spark, d):
    """Alerts of failures in order of arrival; events with a number divisible by eleven close their user's alert."""
    rows = event_stream(spark, d).select(F.lit("rule").alias("kind"), F.lit("failure").alias("rule_id"), "source", F.col("user_id").cast("string").alias("group_key"), "event_id", "at", "action", F.lit(None).cast("long").alias("n"))
    found = _ran(spark, op.alert_fold_stream(rows.where("action = 'error'"), 1440, rows.where("event_id % 11 = 0")), "update")
    last = op.latest(found, ["kind", "rule_id", "source", "group_key", "alert_no"])
    return last.select("source", F.col("group_key").cast("long").alias("user_id"), "alert_no", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), F.col("count").alias("n"), "first_event")


@query(f"""with {EV_SQL}, last as (select user_id, max(us) as last_us from ev group by 1) select user_id, last_us from last where last_us // 1000 + 6 * 3600000 < (select max(us) // 1000 from ev)""")
def q_stream_silence(spark, d):
    return _ran(spark, op.silence_stream(event_stream(spark, d), "user_id", 360), "update").select("user_id", "last_us")


@query(f"with {LINES_SQL} select count(*) as n, sum(length(line))::bigint as chars from lines")
def q_stream_inbox(spark, d):
    """The documents' lines as text files in a folder, followed as a stream."""
    from logquarry.jobs.query import raw_lines
    from logquarry.sources.records import stream_inbox

    path = scratch_path(spark, "inbox")
    raw_lines(spark, d).select("line").write.option("lineSep", "\n").text(f"{path}/part")
    inbox = stream_inbox(spark, f"{path}/part", "*.txt")
    return _ran(spark, inbox).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars"))


@query("select 'syslog:10.0.0.' || (user_id % 50) as source, count(*) as n, count(distinct event_id) as n_lines from events group by 1")
def q_stream_syslog(spark, d):
    """Events as keyed messages in files, followed as a topic would be."""
    from logquarry.jobs.query import log_events
    from logquarry.sources.records import stream_syslog

    path = scratch_path(spark, "topic")
    sender = F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string"))
    log_events(spark, d).select(sender.cast("binary").alias("key"), F.concat_ws(" ", "action", F.col("event_id").cast("string")).cast("binary").alias("value")).write.parquet(path)
    rows = _ran(spark, stream_syslog(spark, {"path": path}, "parquet", "key binary, value binary"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("n_lines"))
