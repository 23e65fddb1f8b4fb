"""Structured Streaming forms of routing, counting, matching and alerting."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logquarry.operators.detection import earlier_count, live_count, match_rules, with_groups
from logquarry.operators.ingest import minute_stats, route_records, upsert_hosts
from logquarry.operators.rules import Rule
from logquarry.sources.batches import BatchStore, latest_batch


def route_stream(records: DataFrame, hosts: DataFrame) -> DataFrame:
    """A stream of records with status, route and held; hosts is a table, read anew for each batch."""
    return route_records(records, hosts)


#: What a routed stream's records are kept with, and the tables made of them.
LINES = "source string, raw string, received_at timestamp, ecs string, parser_id string, skew double, held boolean, route string"
HOST_GAINS = "source string, status string, first_seen timestamp, last_seen timestamp, lines long"
COUNTER_GAINS = "source string, minute timestamp, total long, parsed long, skew_sum double, skew_n long"


def route_to(records: DataFrame, hosts: DataFrame, store: BatchStore, checkpoint: str, auto_approve: bool = False, key: str | None = None) -> None:
    """Route a stream of records (source, raw, received_at, ecs, parser_id, skew) until there are no more: into
    the store's tables lines (events and quarantine, by route), hosts and counters (what senders and minute
    counters gain), all of one batch together.

    A batch that the store has is not written again, so a run that dies between the store's mark and the
    checkpoint's does not double it; one that dies before the mark leaves nothing that counts.  Counters are
    made of the lines as written, so both tell the same even if hosts change meanwhile.  key: a column of
    records to keep with the lines.
    """
    kept = [*([key] if key else []), *(f.split()[0] for f in LINES.split(", "))]

    def write(batch: DataFrame, number: int) -> None:
        if store.has(number):
            return
        routed = route_records(batch, hosts, auto_approve)
        lines = store.put(number, "lines", routed.where("route <> 'dropped'").select(*kept), ["route"])
        store.put(number, "counters", minute_stats(lines))
        none = batch.sparkSession.createDataFrame([], HOST_GAINS)
        store.put(number, "hosts", upsert_hosts(none, batch, auto_approve))
        store.commit(number)

    query = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def routed_lines(store: BatchStore, key: str = "") -> DataFrame:
    """The lines that route_to() has written; key: its column as text, such as 'event_id long'."""
    return store.read("lines", f"{key}, {LINES}" if key else LINES)


def host_gains(store: BatchStore, hosts: DataFrame) -> DataFrame:
    """hosts (source, status, first_seen, last_seen, lines) after all batches of a store."""
    gained = store.read("hosts", HOST_GAINS).groupBy("source").agg(F.min("status").alias("_s"), F.min("first_seen").alias("_f"), F.max("last_seen").alias("_l"), F.sum("lines").alias("_n"))
    return hosts.join(gained, "source", "full").select(
        "source", F.coalesce("status", "_s").alias("status"), F.coalesce("first_seen", "_f").alias("first_seen"), F.greatest("last_seen", "_l").alias("last_seen"),
        (F.coalesce("lines", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("lines"),
    )


def minute_stats_stream(routed: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counters per sender and minute of a routed stream (received_at, route, skew).

    Lines later than ``late`` behind the newest are left to the batch back-test.
    """
    return (
        routed.where("route <> 'dropped'")
        .withWatermark("received_at", late)
        .groupBy("source", F.window("received_at", "1 minute"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("route") == "event").alias("parsed"), F.coalesce(F.sum("skew"), F.lit(0.0)).alias("skew_sum"), F.count("skew").alias("skew_n"))
        .select("source", F.col("window.start").alias("minute"), "total", "parsed", "skew_sum", "skew_n")
    )


def matches_stream(events: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("event_id", "source", "at")) -> DataFrame:
    """Rule matches of a stream of events; the checkpoint takes the place of a cursor."""
    return match_rules(events, rules, keep)


def correlate_to(matches: DataFrame, group: Sequence[str], span: int, store: BatchStore, checkpoint: str, key: Sequence[str] = ("source",)) -> None:
    """Correlate a stream of matches (event_id, key, group, at) until there are no more: into the store's table
    counts (the match, n), where n says how many matches of its key and group that had arrived lie in the span
    seconds up to it.  Earlier batches have arrived; within a batch arrival goes by event_id, unique in it.
    Matches without a time, a key or one of the grouping fields count nowhere.

    What is remembered is a table too, instants: one row for each batch, key, group and instant, so a flooding
    sender is summed and no task holds a key.  A batch reads only the days that its own times reach back to,
    and there is no watermark: however late a match is, it is counted and counts for those that come after
    it.  A batch that the store has is not written again.
    """
    by = [*key, *group]
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    instants = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "at"]) + ", c long, day long"
    us, a_day = F.unix_micros("at"), 86_400_000_000
    given = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*key, "at"]))

    def write(batch: DataFrame, number: int) -> None:
        if store.has(number):
            return
        rows = store.put(number, "matches", with_groups(batch, group).where(given).select("event_id", *by, "at")).drop("batch")
        day = F.floor(us / a_day).alias("day")
        store.put(number, "instants", rows.groupBy(*by, "at").agg(F.count(F.lit(1)).alias("c")).select(*by, "at", "c", day), ["day"])
        first, last = rows.agg(F.min(us), F.max(us)).first()
        if first is None:
            store.put(number, "counts", rows.withColumn("n", F.lit(0).cast("long")))
        else:
            low = first - span * 1_000_000
            past = store.read("instants", instants).where(us.between(low, last) & F.col("day").between(low // a_day, last // a_day))
            now = live_count(rows, group, span, key, save=lambda df: store.put(number, "arrivals", df).drop("batch"))
            counted = earlier_count(now, past, group, span, key).withColumn("n", F.col("n") + F.col("earlier"))
            store.put(number, "counts", counted.select("event_id", *by, "at", "n"))
        for helper in ("matches", "arrivals"):
            store.drop(number, helper)
        store.commit(number)

    query = matches.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def correlated(store: BatchStore, like: DataFrame, group: Sequence[str], key: Sequence[str] = ("source",)) -> DataFrame:
    """The matches that correlate_to() has counted, with n; like has their columns."""
    return store.read("counts", like.select("event_id", *key, *group, "at", F.lit(0).cast("long").alias("n")))


def correlation_stream(matches: DataFrame, group: Sequence[str], span: int, late: str = "1 hour", field: str | None = None) -> DataFrame:
    """A stream of matches (event_id, source, at, group) with n: how many matches of the same sender and
    group that had arrived lie in the span seconds up to each, or how many distinct values of field they
    have (a missing one counts as a value).

    A match is seen for the span seconds from its time on; where a match of its value that came before it is
    seen already, only for the rest, which is one stretch as all are equally long.  So n is the number of
    stretches that have begun less those that are over, two searches in sorted lists whatever the window
    holds.  State is what the watermark can still reach, so it shrinks with time; a key without matches for
    that long is dropped.  Matches that arrive later than ``late`` are dropped by the watermark:
    correlate_to() counts those too.
    """
    keys = ["source", *group]
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", event_id long, n long"
    reach = span * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, ends, names, lists = map(list, state.get) if state.exists else ([], [], [], [])
        times = {v: list(ts) for v, ts in zip(names, lists)}
        out = []
        for frame in sorted_frames(frames):
            for event_id, us, value in zip(frame["event_id"], map(int, frame["us"]), frame["value"]):
                start, end = us, us + reach + 1
                if field:
                    same = times.setdefault(value, [])
                    at = bisect_left(same, us)
                    start = max(start, same[at - 1] + reach + 1) if at else start
                    end = min(end, same[at]) if at < len(same) else end
                    if at == len(same) or same[at] != us:
                        same.insert(at, us)
                if start < end:
                    insort(starts, start)
                    insort(ends, end)
                out.append((*key, int(event_id), bisect_right(starts, us) - bisect_right(ends, us)))
        horizon = state.getCurrentWatermarkMs() * 1000
        over = bisect_right(ends, horizon)  # as many have begun before, and none of them is asked for again
        known = {v: ts[bisect_left(ts, horizon - reach) :] for v, ts in times.items()}
        known = {v: ts for v, ts in known.items() if ts}
        state.update((starts[over:], ends[over:], list(known), list(known.values())))
        state.setTimeoutTimestamp(max(max(ends, default=0) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "event_id", "n"])

    value = F.coalesce(F.to_json(F.struct(F.col(field).alias("v"))), F.lit("null")) if field else F.lit("")
    rows = matches.withWatermark("at", late).withColumn("us", F.unix_micros("at")).withColumn("value", value).select(*keys, "event_id", "us", "value", "at")
    kept = "starts array<long>, ends array<long>, names array<string>, times array<array<long>>"
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, kept, "update", GroupStateTimeout.EventTimeTimeout)


def sorted_frames(frames: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
    """A key's rows of one batch, in order of arrival."""
    rows = [f for f in frames if len(f)]
    return [pd.concat(rows).sort_values("event_id")] if rows else []


def alert_stream(hits: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Alerts as sessions of hits (kind, rule_id, source, group_key, at): hits at most minutes apart merge."""
    key = ["kind", "rule_id", "source", "group_key"]
    return (
        hits.withWatermark("at", late)
        .groupBy(*key, F.session_window("at", f"{minutes} minutes"))
        .agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("count"))
        .drop("session_window")
    )


def alert_fold_stream(hits: DataFrame, minutes: int = 60, closed: DataFrame | None = None) -> DataFrame:
    """Alerts folded as alerts.dedup() does, from a stream of hits (kind, rule_id, source, group_key, event_id,
    at, n) and one of decisions (the key, event_id): rows of update mode by key and alert_no.

    Hits count in order of arrival: by batches, and by event_id within one.  A late hit joins the latest open
    alert, whatever its time, so there is no watermark that could lose it.  A decision closes what is open
    when it comes; the next hit opens another alert.  State is one alert for each key, whatever its hits.
    """
    key = ["kind", "rule_id", "source", "group_key"]
    rows = hits.select(*key, "event_id", F.unix_micros("at").alias("us"), "n", F.lit(False).alias("ends"))
    if closed is not None:
        rows = rows.unionByName(closed.select(*key, "event_id", F.lit(True).alias("ends")), allowMissingColumns=True)
    schema = "kind string, rule_id string, source string, group_key string, alert_no long, first_us long, last_us long, count long, first_event long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, open_, first, last, hits_n, most, first_event = state.get if state.exists else (0, False, 0, 0, 0, -1, 0)
        changed: dict[int, tuple] = {}
        mine = pd.concat([f for f in frames if len(f)]).sort_values(["event_id", "ends"])
        for event_id, us, n, ends in zip(mine["event_id"], mine["us"], mine["n"], mine["ends"]):
            if ends:
                open_ = False
                continue
            if not open_ or us - minutes * 60_000_000 > last:
                no, open_, first, last, hits_n, most, first_event = no + 1, True, us, us, 0, -1, event_id
            first, last, hits_n = min(first, us), max(last, us), hits_n + 1
            most = most if pd.isna(n) else max(most, n)
            changed[no] = (no, first, last, hits_n if most < 0 else most, first_event)
        state.update(tuple(map(int, (no,))) + (bool(open_),) + tuple(map(int, (first, last, hits_n, most, first_event))))
        yield pd.DataFrame([(*k, *map(int, c)) for c in changed.values()], columns=[*key, "alert_no", "first_us", "last_us", "count", "first_event"])

    kept = "no long, open boolean, first long, last long, hits long, most long, first_event long"
    found = rows.groupBy(*key).applyInPandasWithState(step, schema, kept, "update", GroupStateTimeout.NoTimeout)
    seen = [F.timestamp_micros(c).alias(n) for c, n in (("first_us", "first_seen"), ("last_us", "last_seen"))]
    return found.select(*key, "alert_no", *seen, "count", "first_event")


def silence_stream(lines: DataFrame, by: str, minutes: int, late: str = "0 minutes") -> DataFrame:
    """by, last_us of senders that sent nothing for minutes while others did: an event-time timer per sender."""
    kind = {f.name: f.dataType.simpleString() for f in lines.schema}[by]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=[by, "last_us"])
            return
        last = state.get[0] if state.exists else 0
        last = max([last, *(int(f["us"].max()) for f in frames if len(f))])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    rows = lines.withWatermark("at", late).select(by, "at", F.unix_micros("at").alias("us"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, last_us long", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what there is and stop; the rows of this and earlier runs with batch, the number of the batch
    that wrote them.  Rows are in a store under path, the checkpoint beside them.

    A batch that the store has is not written again, so replays double nothing.  In complete mode the rows
    are those of the last batch.
    """
    store = BatchStore(stream.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        if not store.has(number):
            store.put(number, "rows", batch)
            store.commit(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = store.read("rows", stream)
    return latest_batch(rows) if mode == "complete" else rows


def latest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last state of each key in rows that an update-mode stream has written."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    top = rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("_l"))
    return top.select(*key, *(F.col(f"_l.{c}").alias(c) for c in rest))
