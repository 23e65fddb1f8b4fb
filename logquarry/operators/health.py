"""Sender health from minute counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
# The limits that senders are judged by unless they have their own.
DAY = 1440
DEFAULTS = {
    "silence_min_minutes": 30.0, "silence_factor": 10.0, "volume_drop": 0.2, "volume_spike": 5.0,
    "parse_rate_warning": 0.9, "parse_rate_critical": 0.5, "skew_seconds": 300.0,
}


def metrics(stats: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """hosts (source, status, format, thresholds) with what their last 24 hours of minute counters say.

    lines, active (minutes with lines), span (minutes since the first, 15 to 1440), per_minute, silent
    (whole minutes since the last), rate15, hour_total, parse_rate and skew of the last hour.  A day's
    counters take one aggregate; hosts without any keep nulls and zeros.
    """
    floor = F.floor(F.unix_micros(now) / MINUTE).cast("long")
    minute = F.floor(F.unix_micros("minute") / MINUTE).cast("long")
    recent = stats.withColumn("_age", floor - minute).where(F.col("_age").between(0, DAY))
    inside = lambda minutes, c: F.sum(F.when(F.col("_age") < minutes, F.col(c)))
    agg = recent.groupBy("source").agg(
        F.sum("total").alias("lines"), F.count_if(F.col("total") > 0).alias("active"), F.max("_age").alias("_first"), F.min("_age").alias("silent"),
        inside(15, "total").alias("_t15"), inside(60, "total").alias("hour_total"), inside(60, "parsed").alias("_p"), inside(60, "skew_sum").alias("_s"), inside(60, "skew_n").alias("_n"),
    )
    span = F.greatest(F.lit(15), F.least(F.lit(DAY), F.col("_first")))
    return hosts.join(agg, "source", "left").select(
        *hosts.columns, F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("active", F.lit(0)).alias("active"), span.alias("span"),
        (F.coalesce("lines", F.lit(0)) / span).alias("per_minute"), "silent", (F.coalesce("_t15", F.lit(0)) / 15).alias("rate15"),
        F.coalesce("hour_total", F.lit(0)).alias("hour_total"), F.when(F.col("hour_total") > 0, F.col("_p") / F.col("hour_total")).alias("parse_rate"),
        F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("skew"),
    )


def threshold(name: str) -> Column:
    return F.coalesce(F.get(F.transform(F.array(F.col("thresholds")), lambda m: m[name]), F.lit(0)), F.lit(DEFAULTS[name]))


def silence(m: str = "") -> Column:
    """'critical' for a sender with lines that is silent for longer than usual, else null."""
    usual = F.greatest(threshold("silence_min_minutes"), threshold("silence_factor") / F.expr("nullif(per_minute, 0)"))
    return F.when((F.col("lines") > 0) & (F.col("silent") > usual), "critical")


def volume() -> Column:
    """'drop' or 'spike' against the day's rate, for senders of 60 active minutes or more."""
    base, rate = F.col("per_minute"), F.col("rate15")
    known = F.col("active") >= 60
    return F.when(known & (rate > 0) & (rate < threshold("volume_drop") * base), "drop").when(known & (rate > threshold("volume_spike") * base), "spike")


def parse_rate() -> Column:
    """'critical' or 'warning' for too few parsed lines, 'no parser' for an approved sender without one."""
    none = (F.col("status") == "approved") & F.col("format").isNull()
    return F.when(none, "no parser").when(F.col("parse_rate") < threshold("parse_rate_critical"), "critical").when(F.col("parse_rate") < threshold("parse_rate_warning"), "warning")


def skewed() -> Column:
    """'warning' for clocks that differ too much."""
    return F.when(F.col("skew") > threshold("skew_seconds"), "warning")


def status(measured: DataFrame) -> DataFrame:
    """metrics() with status (ok, warning, critical) and reasons in a fixed order."""
    s, v, p, k = silence(), volume(), parse_rate(), skewed()
    reasons = F.array_compact(
        F.array(
            F.when(s.isNotNull(), F.format_string("silent for %d min", F.col("silent"))),
            F.when(v.isNotNull(), F.concat(F.lit("volume "), v)),
            F.when(p == "no parser", "no parser").when(p.isNotNull(), F.format_string("parse rate %d %%", F.round(F.col("parse_rate") * 100).cast("int"))),
            F.when(k.isNotNull(), F.format_string("clock skew %d s", F.round("skew").cast("int"))),
        )
    )
    critical = s.isNotNull() | (p == "critical")
    return measured.withColumn("reasons", reasons).withColumn(
        "status_now", F.when(F.coalesce(critical, F.lit(False)), "critical").when(F.size("reasons") > 0, "warning").otherwise("ok")
    )


def history(checks: DataFrame) -> DataFrame:
    """The checks (source, at, status, reasons) whose status or reasons differ from their predecessor's."""
    w = Window.partitionBy("source").orderBy("at")
    last = F.lag(F.struct("status", "reasons")).over(w)
    return checks.withColumn("_last", last).where(~F.col("_last").eqNullSafe(F.struct("status", "reasons"))).drop("_last")
