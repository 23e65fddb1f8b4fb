"""Alerts from hits: folding, evidence, lists, and checks of stored answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.sources.sinks import LEVELS

OPEN = ("new", "acknowledged")
STATUSES = ("new", "acknowledged", "closed_tp", "closed_fp", "resolved")
KEY = ("kind", "rule_id", "source", "group_key")


#: Event ids of a block of a key's history.
_BLOCK = 1 << 20


def _running(rows: DataFrame, key: Sequence[str], value: Column, how: Callable[[Column | str], Column], name: str, inclusive: bool, block: int = _BLOCK) -> DataFrame:
    """rows with name: how (a sum or maximum) of value over a key's rows up to each, by event_id; the row
    itself belongs to them if inclusive.

    A key's history is cut into blocks of ids.  Blocks are summed up first; only these sums, one row for each
    block, are run through in order, so that no key is worked off by a single task.
    """
    cut = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col("event_id") / block))
    same = [*key, "_block"]
    order = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*same).agg(how("_value").alias("_of")).withColumn("_before", how("_of").over(order)).drop("_of")
    before = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(same)), "_before")
    # At one id a hit comes before what closes its alert.
    inside = Window.partitionBy(*same).orderBy("event_id", *(["_closed"] if "_closed" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = F.array_compact(F.array("_before", how("_value").over(inside)))
    joined = cut.join(before, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(same))))
    total = F.array_max(both) if how is F.max else F.aggregate(both, F.lit(0).cast("long"), lambda a, b: a + b)
    return joined.withColumn(name, total).select(*rows.columns, name)


def dedup(hits: DataFrame, minutes: int = 60, closed: DataFrame | None = None, block: int = _BLOCK) -> DataFrame:
    """Alerts folded from hits (kind, rule_id, source, group_key, event_id, at, n): key, alert_no,
    first_seen, last_seen, count, first_event.

    Hits arrive in order of event_id.  One joins its key's latest alert if that alert's last_seen is at
    most ``minutes`` before it (or after it); otherwise it opens one.  count adds 1 for each hit, or is
    the largest n where hits have one.  closed (key, event_id) closes what is open when that event has
    arrived.  Alerts are islands: a running maximum decides where one starts, and nothing loops.

    block: event ids of a stretch of history that one task runs through.
    """
    rows, us = hits, F.unix_micros("at")
    if closed is None:
        rows = rows.withColumn("_era", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("_closed", F.lit(False)).unionByName(closed.select(*KEY, "event_id", F.lit(True).alias("_closed")), allowMissingColumns=True)
        rows = _running(rows, KEY, F.col("_closed").cast("long"), F.sum, "_era", True, block).where("not _closed")
    rows = _running(rows, [*KEY, "_era"], us, F.max, "_last", False, block)
    starts = F.coalesce(us - minutes * 60_000_000 > F.col("_last"), F.lit(True)).cast("long")
    islands = _running(rows, KEY, starts, F.sum, "alert_no", True, block)
    return islands.groupBy(*KEY, "alert_no").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.coalesce(F.max("n"), F.count(F.lit(1))).alias("count"), F.min("event_id").alias("first_event")
    )


def link_events(evidence: DataFrame, most: int = 200) -> DataFrame:
    """alert_id, event_id: each alert's distinct events in order of arrival, most of them at most.

    evidence: alert_id, event_ids.  The limit is part of what an alert is: it shows its first events.
    """
    each = evidence.select("alert_id", F.explode("event_ids").alias("event_id")).distinct()
    order = Window.partitionBy("alert_id").orderBy("event_id")
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def events_of(alert_links: DataFrame, events: DataFrame, most: int = 50) -> DataFrame:
    """The latest events of each alert."""
    order = Window.partitionBy("alert_id").orderBy(F.desc("event_id"))
    return alert_links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n").join(events, "event_id")


def listed(alerts: DataFrame, status: str = "open", level: str | None = None, most: int = 200) -> DataFrame:
    """The newest alerts of a status (open: new or acknowledged; all) and level."""
    rows = alerts.where(F.col("status").isin(*OPEN)) if status == "open" else alerts if status == "all" else alerts.where(F.col("status") == status)
    rows = rows.where(F.col("level") == level) if level else rows
    return rows.orderBy(F.desc("last_seen"), F.desc("alert_id")).limit(most)


def counts(alerts: DataFrame) -> DataFrame:
    """level, n of open alerts, zero for levels without, and their total."""
    levels = alerts.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    open_ = alerts.where(F.col("status").isin(*OPEN))
    by = F.broadcast(levels).join(open_.groupBy("level").count(), "level", "left").select("level", F.coalesce("count", F.lit(0)).alias("n"))
    return by.unionByName(open_.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("level"), "n"))


def has_alert(rows: DataFrame, alerts: DataFrame, on: list[str], only_open: bool = False, without: bool = False) -> DataFrame:
    """Rows that have an alert by the columns of on (or that have none)."""
    there = alerts.where(F.col("status").isin(*OPEN)) if only_open else alerts
    return rows.join(there.select(*on).distinct(), on, "left_anti" if without else "left_semi")


def new_sender_alerts(hosts: DataFrame, alerts: DataFrame) -> DataFrame:
    """A low alert for each pending sender that never had one of this kind."""
    fresh = has_alert(hosts.where("status = 'pending'"), alerts.where("kind = 'new_sender'"), ["source"], without=True)
    return fresh.select(F.lit("new_sender").alias("kind"), "source", F.lit("low").alias("level"), F.concat(F.lit("New sender "), "source").alias("title"))


def host_critical_alerts(health: DataFrame, hosts: DataFrame, alerts: DataFrame) -> DataFrame:
    """A high alert for each approved sender in critical health without an open one of this kind."""
    bad = health.where("status = 'critical'").join(hosts.where("status = 'approved'").select("source"), "source", "left_semi")
    fresh = has_alert(bad, alerts.where("kind = 'host'"), ["source"], only_open=True, without=True)
    return fresh.select(F.lit("host").alias("kind"), "source", F.lit("high").alias("level"), F.concat_ws("; ", "reasons").alias("title"))


def resolve(alerts: DataFrame, hosts: DataFrame) -> DataFrame:
    """alerts with the open new-sender ones of decided senders resolved."""
    decided = hosts.where("status in ('approved', 'rejected')").select("source", F.lit(True).alias("_done"))
    done = (F.col("kind") == "new_sender") & F.col("status").isin(*OPEN) & F.col("_done").isNotNull()
    return alerts.join(decided, "source", "left").withColumn("status", F.when(done, "resolved").otherwise(F.col("status"))).drop("_done")


def set_status(alerts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with the status of decisions (alert_id, status), decisions with an unknown status)."""
    sound = decisions.where(F.col("status").isin(*STATUSES)).select("alert_id", F.col("status").alias("_s"))
    out = alerts.join(sound, "alert_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    return out, decisions.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull())


def effective_rules(shipped: DataFrame, custom: DataFrame, disabled: DataFrame) -> DataFrame:
    """rule_id, origin of the rules in force: shipped and approved custom ones, but none disabled and none
    that an approved one replaces (replaces: ids divided by commas)."""
    approved = custom.where("status = 'approved'")
    replaced = approved.select(F.explode(F.split("replaces", ",")).alias("rule_id")).select(F.trim("rule_id").alias("rule_id"))
    gone = disabled.select("rule_id").unionByName(replaced).distinct()
    return shipped.select("rule_id", "origin").unionByName(approved.select("rule_id", "origin")).join(gone, "rule_id", "left_anti")


#: What triage answers may say.
VERDICTS = ("true_positive", "false_positive", "uncertain")
_TECHNIQUE = r"^T\d{4}(\.\d{3})?$"
_ENTITY = r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:user|host)-[0-9a-f]{6}\b"


def triage_check(answers: DataFrame) -> DataFrame:
    """answers (alert_id, verdict, severity, confidence, summary, cited, attack, event_ids, rule_attack,
    evidence) with ok, confidence clamped to 0..1, and what is wrong: bad_events (cited, not in the
    evidence), bad_attack (no technique id, or not the rule's), bad_entities (named, not in evidence)."""
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    entities = F.array_distinct(F.regexp_extract_all("summary", F.lit(_ENTITY), 0))
    attack = empty(F.col("attack"), "string")
    return (
        answers.withColumn("bad_events", F.array_except(empty(F.col("cited"), "bigint"), empty(F.col("event_ids"), "bigint")))
        .withColumn("bad_attack", F.filter(attack, lambda a: ~a.rlike(_TECHNIQUE) | ~F.array_contains(empty(F.col("rule_attack"), "string"), a)))
        .withColumn("bad_entities", F.filter(empty(entities, "string"), lambda e: ~F.contains(F.coalesce("evidence", F.lit("")), e)))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
        .withColumn("known", F.coalesce(F.col("verdict").isin(*VERDICTS) & F.col("severity").isin(*LEVELS), F.lit(False)))
        .withColumn("ok", F.expr("known and size(bad_events) = 0 and size(bad_attack) = 0 and size(bad_entities) = 0"))
    )


def evidence_texts(alert_links: DataFrame, events: DataFrame, text: str, most: int = 20, width: int = 400) -> DataFrame:
    """alert_id, evidence: up to most events of each alert, oldest first, their text cut to width."""
    order = Window.partitionBy("alert_id").orderBy("event_id")
    first = alert_links.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    line = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] "), F.substring(text, 1, width))
    rows = first.join(events.select("event_id", line.alias("_line")), "event_id")
    return rows.groupBy("alert_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias("evidence"))
