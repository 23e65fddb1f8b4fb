"""Registration of queries over the test tables, and the projections that stand in for log tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) by its name; sql is the same query for DuckDB."""

    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def instant(ts: str) -> Column:
    """A zone-free timestamp column as an instant, read as UTC whatever the session's zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}))")


def micros(at: str | Column) -> Column:
    return F.unix_micros(at)


def at_literal(text: str) -> Column:
    """A UTC instant."""
    return F.to_timestamp(F.lit(text + "Z"))


#: events as the log table; each is the text of a WITH clause for DuckDB.
EV_SQL = """ev as (
    select event_id, 's' || (user_id % 10) as source, user_id, event_type as action, ts, epoch_us(ts) as us, value,
        json_extract_string(props, '$.k') as port
    from events
)"""


def log_events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, source, user_id, action, at, value, port: the events table as parsed log events."""
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("source"),
        "user_id",
        F.col("event_type").alias("action"),
        instant("ts").alias("at"),
        "value",
        F.get_json_object("props", "$.k").alias("port"),
    )


HOSTS_SQL = """hosts as (
    select 's' || (s_suppkey % 8) as source, min(case s_suppkey % 8 when 0 then 'rejected' when 1 then 'pending' when 2 then 'pending' else 'approved' end) as status
    from supplier group by 1
)"""


def host_table(spark: SparkSession, d: str) -> DataFrame:
    """source, status: senders s0 to s7 from suppliers; s8 and s9 stay unknown."""
    return (
        table(spark, d, "supplier")
        .select(F.concat(F.lit("s"), (F.col("s_suppkey") % 8).cast("string")).alias("source"), (F.col("s_suppkey") % 8).alias("k"))
        .groupBy("source")
        .agg(F.min(F.when(F.col("k") == 0, "rejected").when(F.col("k").isin(1, 2), "pending").otherwise("approved")).alias("status"))
    )


LINES_SQL = """lines as (
    select doc_id, source, pos - 1 as line_no, line
    from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
    where length(trim(line)) > 0
)"""


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, line_no, line: the documents' lines that are not blank."""
    from logquarry.sources.records import lines_of

    return lines_of(table(spark, d, "documents"), "text", "line").select("doc_id", "source", "line_no", "line")
