"""Queries: sender health at a fixed instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs import ingest
from logquarry.jobs.query import at_literal, host_table, micros, query
from logquarry.operators import health as op
from logquarry.operators import ingest as ingest_op

NOW = "2024-01-29 12:00:00"
NOW_US = 1706529600000000

METRIC_SQL = f"""{ingest.REC_SQL}, stats as (select source, us // 60000000 as m, count(*) as total, count(*) filter (route = 'event') as parsed, coalesce(sum(skew), 0) as skew_sum, count(skew) as skew_n from routed where route <> 'dropped' group by 1, 2),
    aged as (select *, {NOW_US // 60_000_000} - m as age from stats where {NOW_US // 60_000_000} - m between 0 and 1440),
    day as (select source, sum(total)::bigint as lines, count(*) as active, max(age) as oldest, min(age) as silent, sum(total) filter (age < 15) as t15, sum(total) filter (age < 60) as t60, sum(parsed) filter (age < 60) as p60,
        sum(skew_sum) filter (age < 60) as s60, sum(skew_n) filter (age < 60) as n60 from aged group by 1),
    known as (select source, status, case when source <> 's5' then 'json' end as format from hosts),
    metrics as (select k.*, coalesce(lines, 0) as lines, coalesce(active, 0) as active, greatest(15, least(1440, oldest)) as span, coalesce(lines, 0) / greatest(15, least(1440, oldest)) as per_minute, silent,
        coalesce(t15, 0) / 15 as rate15, coalesce(t60, 0)::bigint as hour_total, case when t60 > 0 then p60 / t60 end as parse_rate, case when n60 > 0 then s60 / n60 end as skew from known k left join day using (source)),
    judged as (select *, case when lines > 0 and silent > greatest(case when source = 's3' then 1 else 30 end, 10.0 / nullif(per_minute, 0)) then 'critical' end as silence,
        case when active >= 60 and rate15 > 0 and rate15 < 0.2 * per_minute then 'drop' when active >= 60 and rate15 > 5 * per_minute then 'spike' end as volume,
        case when status = 'approved' and format is null then 'no parser' when parse_rate < 0.5 then 'critical' when parse_rate < 0.9 then 'warning' end as parse,
        case when skew > 300 then 'warning' end as clock from metrics)"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Metrics at NOW; s3 counts as silent early, s5 has no parser."""
    hosts = host_table(spark, d).select(
        "source", "status", F.when(F.col("source") != "s5", "json").alias("format"),
        F.when(F.col("source") == "s3", F.create_map(F.lit("silence_min_minutes"), F.lit(1.0))).alias("thresholds"),
    )
    return op.metrics(ingest_op.minute_stats(ingest.routed(spark, d)), hosts, at_literal(NOW))


@query(f"""with {METRIC_SQL} select source, lines, active, span, round(per_minute, 6) as per_minute, silent, round(rate15, 6) as rate15, hour_total, round(parse_rate, 6) as parse_rate, round(skew, 4) as skew from metrics""")
def q_health_metrics(spark, d):
    r = lambda c, n=6: F.round(c, n).alias(c)
    return measured(spark, d).select("source", "lines", "active", "span", r("per_minute"), "silent", r("rate15"), "hour_total", r("parse_rate"), r("skew", 4))


def _flag(name: str, column: str, make) -> None:
    def run(spark, d):
        return measured(spark, d).select("source", make().alias("flag"))

    run.__name__ = name
    query(f"with {METRIC_SQL} select source, {column} as flag from judged")(run)


_flag("health_silence", "silence", op.silence)
_flag("health_volume", "volume", op.volume)
_flag("health_parse_rate", "parse", op.parse_rate)
_flag("health_skew", "clock", op.skewed)


@query(f"""with {METRIC_SQL} select source, case when silence is not null or coalesce(parse, '') = 'critical' then 'critical' when coalesce(volume, parse, clock) is not null then 'warning' else 'ok' end as status_now,
    concat_ws('; ', case when silence is not null then 'silent for ' || silent || ' min' end, 'volume ' || volume,
        case when parse = 'no parser' then parse when parse is not null then 'parse rate ' || round(parse_rate * 100)::int || ' %' end, case when clock is not null then 'clock skew ' || round(skew)::int || ' s' end) as reasons from judged""")
def q_health_status(spark, d):
    return op.status(measured(spark, d)).select("source", "status_now", F.concat_ws("; ", "reasons").alias("reasons"))


@query(f"""with {ingest.REC_SQL}, checks as (select source, us // 3600000000 as h, case when count(*) filter (route = 'event') = 0 then 'warning' else 'ok' end as status, count(*) filter (held) > 0 as held from routed group by 1, 2),
    seen as (select *, lag(status || held) over (partition by source order by h) as before from checks)
    select source, h * 3600000000 as at_us, status from seen where before is distinct from status || held""")
def q_health_history(spark, d):
    """Hourly checks: a warning without parsed lines, a reason where lines are held; only changes stay."""
    hour = F.timestamp_micros((F.floor(micros("received_at") / 3_600_000_000) * 3_600_000_000).cast("long"))
    checks = ingest.routed(spark, d).groupBy("source", hour.alias("at")).agg(
        F.when(F.count_if(F.col("route") == "event") == 0, "warning").otherwise("ok").alias("status"),
        F.when(F.count_if("held") > 0, F.array(F.lit("held"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    return op.history(checks).select("source", micros("at").alias("at_us"), "status")
