"""Rule matches, correlations in sliding windows, and back-tests."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.operators.dominance import arrived_within
from logquarry.operators.rules import Rule
from logquarry.sources.sinks import written

COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq}

#: Rules compiled into one projection; more make the generated method too large to be compiled.
PER_PASS = 50


def match_rules(events: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("event_id", "source", "at")) -> DataFrame:
    """rule_id and the columns of keep for every event that a rule matches; correlations match nothing.

    One pass over events evaluates all rules; each event yields an array of rule ids.  Rules of one kind of
    log go together behind one test of that, so an event meets only the rules on logs of its kind.
    """
    kinds: dict[str, list[Rule]] = {}
    for r in rules:
        if r.matches is not None:
            kinds.setdefault(r.source, []).append(r)
    groups = [same[i : i + PER_PASS] for same in kinds.values() for i in range(0, len(same), PER_PASS)]
    flagged = events
    none = F.array().cast("array<string>")
    for i, group in enumerate(groups):
        hits = F.array_compact(F.array(*(F.when(r.matches, F.lit(r.id)) for r in group)))
        flagged = flagged.withColumn(f"_hits{i}", F.when(group[0].applies, hits).otherwise(none))
    names = [f"_hits{i}" for i in range(len(groups))]
    found = F.flatten(F.array(*names)) if names else F.array().cast("array<string>")
    return flagged.select(*keep, F.explode(found).alias("rule_id")).select("rule_id", *keep)


def silent(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matches of rules that no correlation builds on: those that raise alerts by themselves."""
    bases = {b for r in rules if r.correlation for b in r.correlation.get("rules", ())}
    return matches.where(~F.col("rule_id").isin(*bases)) if bases else matches


def with_groups(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """Matches that have all grouping fields, neither null nor empty."""
    tests = [F.col(g).isNotNull() & (F.col(g).cast("string") != "") for g in group]
    return matches.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


_US = 1_000_000


def _chunked(rows: DataFrame, span: int) -> DataFrame:
    """rows twice: with _chunk, the stretch of span seconds that they lie in (_own), and for the next stretch.

    What lies in the span seconds up to a row has the row's own _chunk, so a key's history is dealt out by
    time and none of it meets in one task.
    """
    chunk = F.floor(F.unix_micros("at") / (max(span, 1) * _US))
    both = F.array(F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own")), F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own")))
    return rows.withColumn("_c2", F.explode(both)).select(*rows.columns, "_c2.*")


def event_count(matches: DataFrame, group: Sequence[str], span: int, key: Sequence[str] = ("source",)) -> DataFrame:
    """matches with n: how many of the same key and group lie in the span seconds up to each.

    Rows are first counted for each instant, so a flooding sender is summed, not kept, by the window.
    """
    found = with_groups(matches, group)
    by = [*key, *group, "at"]
    each = _chunked(found.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")), span)
    frame = Window.partitionBy(*key, *group, "_chunk").orderBy(F.unix_micros("at")).rangeBetween(-span * _US, 0)
    summed = each.withColumn("n", F.sum("_c").over(frame)).where("_own").select(*by, "n")
    return found.join(summed, by)


def value_count(matches: DataFrame, group: Sequence[str], field: str, span: int, key: Sequence[str] = ("source",)) -> DataFrame:
    """matches with n: how many distinct values of field (a missing one counts as one value) lie in the
    span seconds up to each.

    Repeats of a value at one instant go first.  A value then counts from each of its instants until it comes
    again or the span is over, so a running sum of beginnings and ends gives n; no window holds values.
    """
    found = with_groups(matches, group)
    by = [*key, *group, "at"]
    value = F.coalesce(F.to_json(F.struct(F.col(field).alias("v"))), F.lit("null"))
    each = _chunked(found.select(*by, F.xxhash64(value).alias("_v"), value.alias("_text")).distinct(), span)
    part = [*key, *group, "_chunk"]
    us = F.unix_micros("at")
    again = F.lead(us).over(Window.partitionBy(*part, "_v", "_text").orderBy("at"))
    over = F.least(F.coalesce(again, us + span * _US + 1), us + span * _US + 1)
    steps = F.array(F.struct(us.alias("us"), F.lit(1).alias("by"), F.col("_own").alias("own")), F.struct(over.alias("us"), F.lit(-1).alias("by"), F.lit(False).alias("own")))
    step = each.withColumn("_s", steps).select(*part, "at", F.explode("_s").alias("_s"))
    frame = Window.partitionBy(*part).orderBy("_s.us").rangeBetween(Window.unboundedPreceding, 0)
    counted = step.withColumn("n", F.sum("_s.by").over(frame)).where("_s.own").select(*by, "n").distinct()
    return found.join(counted, by)


#: Rows of a key in a stretch of time and the one before it, up to which they meet pair by pair.
_FEW = 256


def live_count(matches: DataFrame, group: Sequence[str], span: int, key: Sequence[str] = ("source",), arrived: str = "event_id", few: int = _FEW, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Like event_count(), counting only matches that had arrived (by ``arrived``, unique) when each one came.
    save: writes a table and reads it back, if not in the scratch folder that goes when the driver ends.

    A match meets those of its stretch of time and the one before it, not all of its key.  Where these are
    more than ``few``, as a flooding sender's are, they are counted by blocks of arrivals and slices of time
    (dominance.py), never met in pairs.
    """
    found = with_groups(matches, group)
    same = [*key, *group, "_chunk"]
    us, low = F.unix_micros("at"), F.unix_micros("at") - span * _US
    near = _chunked(found, span).select(*same, F.col(arrived).cast("long").alias("id"), us.alias("us"), low.alias("low"), F.col("_own").alias("asks"))
    sizes = near.groupBy(*same).agg((F.count(F.lit(1)) > few).alias("_many"))
    sized = save(near.join(sizes, same)) if save else written(near.join(sizes, same), "arrivals")
    little = sized.where("not _many")
    past = little.select(*same, F.col("us").alias("_us"), F.col("id").alias("_id"))
    met = little.where("asks").join(past, same).where("_id <= id and _us between low and us").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counted = met.unionByName(arrived_within(sized.where("_many").drop("_many"), same))
    return found.join(counted.select(F.col("id").alias("_id"), "n"), F.col(arrived) == F.col("_id")).drop("_id")


def earlier_count(matches: DataFrame, past: DataFrame, group: Sequence[str], span: int, key: Sequence[str] = ("source",)) -> DataFrame:
    """matches with earlier: how many of past (key, group, at, c: rows at that instant) lie in the span seconds
    up to each.

    Both are summed by instant; of past, only keys' stretches of time that matches reach are shuffled on.
    """
    by = [*key, *group, "at"]
    same = [*key, *group, "_chunk"]
    asked = matches.select(*by).distinct()
    own = asked.withColumn("_chunk", F.floor(F.unix_micros("at") / (max(span, 1) * _US)))
    reached = _chunked(past.groupBy(*by).agg(F.sum("c").alias("c")), span).select(*same, "at", "c").join(own.select(*same).distinct(), same, "left_semi")
    both = reached.withColumn("_asks", F.lit(False)).unionByName(own.select(*same, "at", F.lit(0).cast("long").alias("c"), F.lit(True).alias("_asks")))
    frame = Window.partitionBy(*same).orderBy(F.unix_micros("at")).rangeBetween(-span * _US, 0)
    summed = both.withColumn("earlier", F.sum("c").over(frame)).where("_asks").select(*by, "earlier")
    return matches.join(summed, by)


def fired(counted: DataFrame, op: str, limit: int) -> DataFrame:
    """Rows whose n meets the condition."""
    return counted.where(COMPARE[op](F.col("n"), F.lit(limit)))


def backtest(events: DataFrame, rules: Sequence[Rule], hours: int | None = None, limit: int | None = 20_000, ids: int | None = None) -> DataFrame:
    """rule_id, kind (base or rule), n, event_ids of matches in the latest events (by event_id, and within
    hours of the newest if given); rules without matches are there with none.

    ids: how many event ids of a rule are kept, the first ones; give it where limit is None, as a rule's
    matches then grow with the table.
    """
    picked = events.orderBy(F.desc("event_id")).limit(limit) if limit else events
    if hours is not None:
        newest = events.agg(F.max("at").alias("_max"))
        picked = picked.join(F.broadcast(newest)).where(F.unix_micros("at") >= F.unix_micros("_max") - hours * 3_600_000_000)
    bases = {b for r in rules if r.correlation for b in r.correlation.get("rules", ())}
    known = events.sparkSession.createDataFrame([(r.id, "base" if r.id in bases else "rule") for r in rules if r.matches is not None], "rule_id string, kind string")
    found = match_rules(picked, rules, ("event_id",))
    sizes = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    if ids is not None:  # the first ones of each rule; a rule that matches everywhere is no list of everything
        order = Window.partitionBy("rule_id").orderBy("event_id")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ids)
    found = sizes.join(found.groupBy("rule_id").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids")), "rule_id")
    return F.broadcast(known).join(found, "rule_id", "left").select(
        "rule_id", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("event_ids", F.expr("cast(array() as array<bigint>)")).alias("event_ids")
    )


def best_windows(counted: DataFrame, group: Sequence[str], span: int, op: str, limit: int, key: Sequence[str] = ("source",), ids: int | None = None) -> DataFrame:
    """key, group, n, at, event_ids: each group's best window (most matches, the earliest on ties) where it
    meets the condition.

    counted has n for each match.  The best window is found first; only its matches are collected.

    ids: how many event ids of a window are kept, the first ones.  Give it where a group may match without
    end: n still counts all, and up to a thousand ids each task sends on no more than so many of a group.
    """
    same = [*key, *group]
    best = counted.groupBy(*same).agg(F.max(F.struct("n", (-F.unix_micros("at")).alias("_t"))).alias("_b")).select(*same, F.col("_b.n").alias("n"), F.timestamp_micros(-F.col("_b._t")).alias("at"))
    best = fired(best, op, limit)
    inside = counted.select(*same, F.col("at").alias("_at"), "event_id")
    low = F.unix_micros("at") - span * 1_000_000
    held = best.join(inside, same).where(F.unix_micros("_at").between(low, F.unix_micros("at")))
    if ids is not None:
        first = Window.partitionBy(*same).orderBy("event_id")
        held = held.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ids)
    return held.groupBy(*same, "n", "at").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"))


def backtest_summary(tested: DataFrame, groups: DataFrame, ids: int = 50, top: int = 20, each: int = 10) -> tuple[DataFrame, DataFrame]:
    """What is kept of a back-test: ids event ids of each rule; the top groups with a few ids each."""
    order = Window.partitionBy("rule_id").orderBy(F.desc("n"), "source", "group_key")
    kept = groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return tested.withColumn("event_ids", F.slice("event_ids", 1, ids)), kept.withColumn("event_ids", F.slice("event_ids", 1, each))


def fp_effect(alerts: DataFrame, links: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: fp, fp_removed, tp, tp_kept, tp_lost of a candidate rule.

    alerts: alert_id, status (closed_fp or closed_tp); links: alert_id, event_id (the evidence); hits:
    alert_id of alerts whose evidence the candidate fires on.  Alerts without evidence do not count.
    """
    judged = alerts.where("status in ('closed_fp', 'closed_tp')").join(links.select("alert_id").distinct(), "alert_id", "left_semi")
    flagged = judged.join(hits.select("alert_id").distinct().withColumn("_hit", F.lit(True)), "alert_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    fp, tp, hit = F.col("status") == "closed_fp", F.col("status") == "closed_tp", F.col("_hit")
    return flagged.agg(
        F.count_if(fp).alias("fp"), F.count_if(fp & ~hit).alias("fp_removed"), F.count_if(tp).alias("tp"), F.count_if(tp & hit).alias("tp_kept"),
        F.array_sort(F.collect_list(F.when(tp & ~hit, F.col("alert_id")))).alias("tp_lost"),
    )


def field_catalogue(leaves: DataFrame, examples: int = 4, width: int = 60, top: int = 80, silent: Sequence[str] = ("event.original", "@timestamp")) -> DataFrame:
    """path, n (documents that have it), examples (the least distinct values, cut to width), for the most
    frequent paths of leaves (doc_id, path, value)."""
    shown = F.when(~F.col("path").isin(*silent), F.substring("value", 1, width))
    docs = leaves.groupBy("path").agg(F.count_distinct("doc_id").alias("n"))
    order = Window.partitionBy("path").orderBy("value")
    few = leaves.select("path", shown.alias("value")).where("value is not null").distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= examples)
    kept = few.groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return docs.orderBy(F.desc("n"), "path").limit(top).join(kept, "path", "left")
