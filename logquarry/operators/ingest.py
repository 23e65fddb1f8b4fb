"""Routing of records by sender status, and upkeep of senders, quarantine and minute counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.sources.batches import BatchStore

THRESHOLDS = (
    "silence_min_minutes", "silence_factor", "volume_drop", "volume_spike", "parse_rate_warning", "parse_rate_critical", "skew_seconds",
)


def route_records(records: DataFrame, hosts: DataFrame, auto_approve: bool = False) -> DataFrame:
    """records (source, raw, received_at, ecs, parser_id, ...) with status, route and held.

    Unknown senders are pending (approved with auto_approve).  Rejected senders' records are dropped,
    parsed ones of approved senders become events, the rest goes to quarantine, held unless approved.
    """
    status = F.coalesce("_status", F.lit("approved" if auto_approve else "pending"))
    parsed = F.col("ecs").isNotNull() & (F.coalesce("parser_id", F.lit("")) != "")
    route = F.when(F.col("status") == "rejected", "dropped").when((F.col("status") == "approved") & parsed, "event").otherwise("quarantine")
    return (
        records.join(hosts.select("source", F.col("status").alias("_status")), "source", "left")
        .withColumn("status", status)
        .drop("_status")
        .withColumn("route", route)
        .withColumn("held", (F.col("route") == "quarantine") & (F.col("status") != "approved"))
    )


def route_counts(routed: DataFrame) -> DataFrame:
    """One row: events, unparsed, held, dropped."""
    return routed.agg(
        F.count_if(F.col("route") == "event").alias("events"),
        F.count_if((F.col("route") == "quarantine") & ~F.col("held")).alias("unparsed"),
        F.count_if("held").alias("held"),
        F.count_if(F.col("route") == "dropped").alias("dropped"),
    )


def upsert_hosts(hosts: DataFrame, records: DataFrame, auto_approve: bool = False) -> DataFrame:
    """hosts (source, status, first_seen, last_seen, lines) after records; rejected senders count too."""
    new = records.groupBy("source").agg(F.min("received_at").alias("_first"), F.max("received_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return hosts.join(new, "source", "full").select(
        "source",
        F.coalesce("status", F.lit("approved" if auto_approve else "pending")).alias("status"),
        F.coalesce("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        (F.coalesce("lines", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("lines"),
    )


def decide_hosts(hosts: DataFrame, decisions: DataFrame) -> DataFrame:
    """hosts with the status of decisions (source, status)."""
    return hosts.join(decisions.select("source", F.col("status").alias("_new")), "source", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def release_or_drop(quarantine: DataFrame, decisions: DataFrame) -> DataFrame:
    """Held lines of approved senders become ordinary quarantine, those of rejected senders go."""
    return (
        quarantine.join(decisions.select("source", F.col("status").alias("_new")), "source", "left")
        .where("not (held and _new <=> 'rejected')")
        .withColumn("held", F.expr("held and not (_new <=> 'approved')"))
        .drop("_new")
    )


def set_thresholds(hosts: DataFrame, changes: DataFrame) -> DataFrame:
    """hosts with thresholds (map) overlaid by changes (source, values map): unknown keys and negative
    values are ignored, a null value removes a key."""
    known = F.array(*map(F.lit, THRESHOLDS))
    old = F.coalesce("thresholds", F.expr("cast(map() as map<string,double>)"))
    fresh = F.map_filter(F.coalesce("values", F.expr("cast(map() as map<string,double>)")), lambda k, v: F.array_contains(known, k) & (v.isNull() | (v >= 0)))
    merged = F.map_concat(F.map_filter("_old", lambda k, v: ~F.array_contains(F.map_keys("_fresh"), k)), F.map_filter("_fresh", lambda k, v: v.isNotNull()))
    return (
        hosts.join(changes, "source", "left").withColumn("_old", old).withColumn("_fresh", fresh).withColumn("thresholds", merged).drop("_old", "_fresh", "values")
    )


def backfill(quarantine: DataFrame, parsed: DataFrame, limit: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(events, remaining quarantine) after parsing the oldest limit lines of each sender again.

    quarantine: line_id, source, received_at, raw, held; parsed: line_id, doc (null where it failed), and
    event_at, the document's own time, if there is one.  Held lines stay.  An event keeps its line as raw.
    backfill_counters() tells what minute counters gain.
    """
    first = Window.partitionBy("source").orderBy("line_id")
    tried = quarantine.where("not held").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
    made = ["doc", *(c for c in parsed.columns if c == "event_at")]
    done = tried.join(parsed.where("doc is not null").select("line_id", *made), "line_id").select("line_id", "source", "received_at", "raw", *made)
    return done, quarantine.join(done.select("line_id"), "line_id", "left_anti")


COUNTERS = ("total", "parsed", "skew_sum", "skew_n")


def _minute(at: Column | str) -> Column:
    return F.timestamp_micros((F.floor(F.unix_micros(at) / 60_000_000) * 60_000_000).cast("long"))


def merge_counters(counters: DataFrame) -> DataFrame:
    """Counters of each source and minute, summed: tables of counters, batch by batch, are one table."""
    return counters.groupBy("source", "minute").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def backfill_counters(done: DataFrame) -> DataFrame:
    """What minute counters gain by lines that were counted as not parsed when they came: source, minute,
    total (0), parsed, skew_sum, skew_n.

    done (line_id, source, received_at, and event_at, the document's own time, if it has one): a line counts
    once, however often it is there.
    """
    skew = clock_skew(F.col("event_at"), F.col("received_at"))
    each = done.groupBy("line_id").agg(F.min(F.struct("source", "received_at", "event_at")).alias("_l")).select("_l.*")
    return each.withColumn("_skew", skew).groupBy("source", _minute("received_at").alias("minute")).agg(
        F.lit(0).cast("long").alias("total"), F.count(F.lit(1)).alias("parsed"), F.coalesce(F.sum("_skew"), F.lit(0.0)).alias("skew_sum"), F.count("_skew").alias("skew_n")
    )


def mend_counters(counters: DataFrame, gained: DataFrame) -> DataFrame:
    """counters with what they gained added; minutes that have no counter gain none."""
    kept = gained.join(counters.select("source", "minute"), ["source", "minute"], "left_semi").select("source", "minute", *COUNTERS)
    return merge_counters(counters.select("source", "minute", *COUNTERS).unionByName(kept))


#: The tables of a backfill store: lines moved to events, and what counters gained.
MOVED = "line_id long, source string, received_at timestamp, raw string, doc string, event_at timestamp"
GAINED = "source string, minute timestamp, total long, parsed long, skew_sum double, skew_n long"


def run_backfill(store: BatchStore, run: int, quarantine: DataFrame, parsed: DataFrame, limit: int = 5000) -> None:
    """backfill() as a batch of a store: moved lines (events) and what counters gained (counters).

    run numbers the attempts, one for each activation of a parser.  A run that was written is not written
    again, and lines that earlier runs have moved are not tried, so each line changes its counter once.
    """
    if store.has(run):
        return
    earlier = store.read("events", MOVED).select("line_id")
    done, _ = backfill(quarantine.join(earlier, "line_id", "left_anti"), parsed, limit)
    kept = [f.split()[0] for f in MOVED.split(", ")]
    moved = store.put(run, "events", (done if "event_at" in done.columns else done.withColumn("event_at", F.lit(None).cast("timestamp"))).select(*kept))
    store.put(run, "counters", backfill_counters(moved))
    store.commit(run)


def activate_parser(parsers: DataFrame) -> DataFrame:
    """parsers (parser_id, source, status, decided_at): of a source's approved ones only the latest stays
    approved, the others are superseded."""
    latest = Window.partitionBy("source", "status").orderBy(F.desc("decided_at"), F.desc("parser_id"))
    return parsers.withColumn("_n", F.row_number().over(latest)).withColumn("status", F.expr("if(status = 'approved' and _n > 1, 'superseded', status)")).drop("_n")


def quarantine_stats(quarantine: DataFrame) -> DataFrame:
    """Per sender of lines not held: count, first and last, most lines first."""
    return quarantine.where("not held").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first"), F.max("received_at").alias("last")).orderBy(F.desc("n"), "source")


def newest(rows: DataFrame, n: int, key: str, descending: bool = True) -> DataFrame:
    """The n rows with the largest (or least) key: a top-n, no full sort."""
    return rows.orderBy(F.desc(key) if descending else F.asc(key)).limit(n)


def newest_by(rows: DataFrame, n: int, key: str, by: str, descending: bool = True) -> DataFrame:
    """The n rows with the largest (or least) key for each value of by."""
    w = Window.partitionBy(by).orderBy(F.desc(key) if descending else F.asc(key))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def hosts_list(hosts: DataFrame, status: str | None = None) -> DataFrame:
    """hosts, oldest first, with thresholds (JSON) as a map."""
    rows = hosts.where(F.col("status") == status) if status else hosts
    return rows.withColumn("thresholds", F.from_json("thresholds", "map<string,double>")).orderBy("first_seen", "source")


def recent_raw(quarantine: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """The latest raw lines: quarantined ones first (by line_id), then events (by event_id), limit in all."""
    q = newest(quarantine, limit, "line_id").select(F.lit(0).alias("kind"), F.col("line_id").alias("id"), "raw")
    e = newest(events, limit, "event_id").select(F.lit(1).alias("kind"), F.col("event_id").alias("id"), "raw")
    return q.unionByName(e).orderBy("kind", F.desc("id")).limit(limit)


def context_events(events: DataFrame, limit: int = 2000, sources: int = 6) -> DataFrame:
    """The newest event of each sender among the latest limit events, for the senders of the newest ones."""
    return newest(newest_by(newest(events, limit, "event_id"), 1, "event_id", "source"), sources, "event_id")


def event_time(timestamp_text: Column, received_at: Column) -> Column:
    """A document's own time where it parses, else when it was received."""
    return F.coalesce(F.try_to_timestamp(timestamp_text), received_at)


def clock_skew(timestamp: Column, received_at: Column) -> Column:
    """Seconds between a document's own time and its receipt; null without the former."""
    return F.abs(F.unix_micros(received_at) - F.unix_micros(timestamp)) / 1e6


def minute_stats(routed: DataFrame) -> DataFrame:
    """source, minute, total, parsed, skew_sum, skew_n of routed records (received_at, route, skew).

    Held lines count in total, dropped ones nowhere.  Partial sums keep chatty senders off the shuffle.
    """
    return (
        routed.where("route <> 'dropped'")
        .groupBy("source", _minute("received_at").alias("minute"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("route") == "event").alias("parsed"),
            F.coalesce(F.sum("skew"), F.lit(0.0)).alias("skew_sum"),
            F.count("skew").alias("skew_n"),
        )
    )


def summary(hosts: DataFrame, events: DataFrame, quarantine: DataFrame, parsers: DataFrame) -> DataFrame:
    """what, n: hosts and parsers by status, events, quarantined and held lines."""
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    by = lambda df, what: df.groupBy("status").count().select(F.concat(F.lit(what + ":"), "status").alias("what"), F.col("count").alias("n"))
    parts = [by(hosts, "hosts"), by(parsers, "parsers"), one(events, "events"), one(quarantine.where("not held"), "quarantined"), one(quarantine.where("held"), "held")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
