"""Scores of parsers, hunts and evaluation runs against labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that parsers are scored on, and fields whose values are sensitive.
SCORED = (
    "@timestamp", "event.action", "event.outcome", "process.name", "process.pid", "source.ip", "source.port", "destination.ip", "destination.port",
    "user.name", "host.hostname", "network.transport", "http.request.method", "http.response.status_code", "url.original", "user_agent.original", "dns.question.name",
)


def field_f1(predicted: DataFrame, expected: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over (doc_id, field, values array) of both sides.

    Overlapping value sets are a hit, differing ones a false positive and a false negative.  Fields absent
    on both sides do not count.
    """
    p = predicted.select("doc_id", "field", F.col("values").alias("_p"))
    both = p.join(expected.select("doc_id", "field", F.col("values").alias("_e")), ["doc_id", "field"], "full")
    hit = F.coalesce(F.arrays_overlap("_p", "_e"), F.lit(False))
    counts = both.agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("_p").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("_e").isNotNull() & ~hit).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def split_halves(rows: DataFrame, by: str = "fixture", order: str = "line_no") -> DataFrame:
    """rows with visible: the first half of each group, one row at least."""
    w = Window.partitionBy(by)
    half = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 2))
    return rows.withColumn("visible", F.row_number().over(w.orderBy(order)) <= half)


def heldout_parsed(rows: DataFrame, by: str = "fixture") -> DataFrame:
    """Share of the rows that were not visible and are parsed, by group."""
    return rows.where("not visible").groupBy(by).agg(F.avg(F.col("parsed").cast("double")).alias("rate"))


def contains_value(text: Column, value: Column) -> Column:
    """Whether a value stands in a text, not inside a longer word or address."""
    quoted = F.regexp_replace(value, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\w.-])"), quoted, F.lit(r"(?![\w-])")))


def leak_rate(values: DataFrame) -> DataFrame:
    """field, leaked, total, rate, and a row without field for all: how many sensitive values of a line
    survive its pseudonymisation.

    values: field, value, raw, outgoing.  Values that are no literal part of the raw line, paths and
    loopback addresses do not count.
    """
    counted = values.where(~F.col("value").isin("127.0.0.1", "::1", "localhost", "-", "") & ~F.col("value").startswith("/") & contains_value(F.col("raw"), F.col("value")))
    leaked = contains_value(F.col("outgoing"), F.col("value"))
    return counted.rollup("field").agg(F.count_if(leaked).alias("leaked"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.col("leaked") / F.col("total"))


def learn_effect(values: DataFrame, caught: DataFrame) -> DataFrame:
    """fixture, leaked_before, leaked_after, total, caught_sensitive, caught_other.

    values: fixture, value, raw, before, after (the line pseudonymised without and with learned rules);
    caught: fixture, value of what learned rules matched.
    """
    v = values.where(contains_value(F.col("raw"), F.col("value")))
    leaks = v.groupBy("fixture").agg(
        F.count_if(contains_value(F.col("before"), F.col("value"))).alias("leaked_before"), F.count_if(contains_value(F.col("after"), F.col("value"))).alias("leaked_after"), F.count(F.lit(1)).alias("total")
    )
    known = values.select("fixture", "value").distinct().withColumn("_known", F.lit(True))
    hits = caught.select("fixture", "value").distinct().join(known, ["fixture", "value"], "left").groupBy("fixture")
    hits = hits.agg(F.count("_known").alias("caught_sensitive"), F.count_if(F.col("_known").isNull()).alias("caught_other"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return leaks.join(hits, "fixture", "left").select("fixture", "leaked_before", "leaked_after", "total", zero("caught_sensitive"), zero("caught_other"))


def eval_report(runs: DataFrame, config: list[str]) -> DataFrame:
    """Per configuration: runs, pass1 (mean share of passed runs), passk (share of fixtures that passed
    once), mean f1 of all runs and of those that proposed something, and mean parsed, attempts, latency."""
    by_fixture = runs.groupBy(*config, "fixture").agg(F.max(F.col("passed").cast("double")).alias("_any"))
    k = by_fixture.groupBy(*config).agg(F.avg("_any").alias("passk"), F.count(F.lit(1)).alias("fixtures"))
    out = runs.groupBy(*config).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("passed").cast("double")).alias("pass1"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"), F.avg("f1").alias("f1_proposed"),
        F.avg("parsed").alias("parsed"), F.avg("attempts").alias("attempts"), F.avg("latency").alias("latency"), F.sum("ungrounded").alias("ungrounded"),
    )
    return out.join(k, config)


def pending_runs(cases: DataFrame, models: DataFrame, runs: int, done: DataFrame) -> DataFrame:
    """case, model, run of the grid that have no result; cases and models are small dimensions."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    listed = models.agg(F.collect_set("model").alias("_m"))  # one row
    grid = cases.select("case").distinct().join(F.broadcast(listed)).select("case", F.explode("_m").alias("model")).select("case", "model", numbers)
    return grid.join(done.select("case", "model", "run").distinct(), ["case", "model", "run"], "left_anti")


def hunt_expected(events: DataFrame, cases: DataFrame) -> DataFrame:
    """n, id: for each case, the events that carry one of its labels, or its group values.

    events: event_id, labels; cases: n, labels, groups.
    """
    wanted = cases.where("labels is not null").select("n", F.explode("labels").alias("label"))
    by_label = events.select("event_id", F.explode("labels").alias("label")).join(wanted, "label").select("n", F.col("event_id").cast("string").alias("id"))
    by_group = cases.where("groups is not null").select("n", F.explode("groups").alias("id"))
    return by_label.unionByName(by_group).distinct()


def hunt_score(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """n, expected, returned, precision, recall, exact of each case from (n, id) of both sides."""
    e = expected.distinct().withColumn("_e", F.lit(1))
    both = e.join(answered.select("n", "id").distinct().withColumn("_a", F.lit(1)), ["n", "id"], "full")
    hit = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    out = both.groupBy("n").agg(F.count("_e").alias("expected"), F.count("_a").alias("returned"), F.count_if(hit).alias("_h"))
    ratio = lambda of: F.when(F.col(of) > 0, F.col("_h") / F.col(of)).otherwise(F.lit(0.0))
    exact = (F.col("_h") == F.col("expected")) & (F.col("_h") == F.col("returned"))
    return out.select("n", "expected", "returned", ratio("returned").alias("precision"), ratio("expected").alias("recall"), exact.alias("exact"))


def hunt_summary(rows: DataFrame) -> DataFrame:
    """Per set: cases, valid, exact (shares), mean precision, recall and attempts."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return rows.groupBy("set").agg(F.count(F.lit(1)).alias("cases"), share("valid"), share("exact"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("attempts").alias("attempts"))
