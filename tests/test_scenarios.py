"""Small cases with known answers."""

import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logquarry.functions import entities as ent
from logquarry.functions.addresses import in_network, ipv6_digits
from logquarry.functions.documents import leaves
from logquarry.functions.keyed import hmac_hex
from logquarry.operators import alerts, detection, health, ingest, parsing, pseudonyms, rules, scoring

T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
KEY = b"scenario key"


def events(spark, spec):
    """(event_id, source, ip, seconds, port) rows."""
    rows = [(i, s, ip, T0 + timedelta(seconds=t), port) for i, (s, ip, t, port) in enumerate(spec)]
    return spark.createDataFrame(rows, "event_id long, source string, ip string, at timestamp, port int")


def burst(n, ip="203.0.113.5", start=0, port=None):
    return [("syslog:gw", ip, start + i, port if port is not None else i) for i in range(n)]


def alerts_of(spark, spec):
    counted = detection.fired(detection.event_count(events(spark, spec), ["ip"], 300), "gte", 10)
    hits = counted.select(F.lit("rule").alias("kind"), F.lit("burst").alias("rule_id"), "source", F.col("ip").alias("group_key"), "event_id", "at", "n")
    return alerts.dedup(hits).collect()


def test_failures_of_one_address(spark):
    few = burst(9) + burst(3, "198.51.100.7", 20)
    assert alerts_of(spark, few) == []
    more = alerts_of(spark, few + burst(3, start=30))
    assert [(a["group_key"], a["count"]) for a in more] == [("203.0.113.5", 12)]
    assert [a["count"] for a in alerts_of(spark, few + burst(4, start=30))] == [13]


def test_distinct_ports(spark):
    one = events(spark, burst(30, port=443))
    assert detection.fired(detection.value_count(one, ["ip"], "port", 120), "gte", 20).count() == 0
    many = events(spark, burst(30, port=443) + burst(20, start=40))
    assert detection.value_count(many, ["ip"], "port", 120).agg(F.max("n")).first()[0] == 21


def test_window_ends_are_inside_and_missing_values_count_once(spark):
    e = events(spark, [("s", "1.1.1.1", 0, 1), ("s", "1.1.1.1", 300, 2), ("s", "1.1.1.1", 601, 3), ("s", None, 1, 1), ("s", "", 1, 1)])
    assert sorted(r["n"] for r in detection.event_count(e, ["ip"], 300).collect()) == [1, 1, 2]
    n = events(spark, [("s", "1.1.1.1", 0, None), ("s", "1.1.1.1", 1, None), ("s", "1.1.1.1", 2, 5)])
    assert max(r["n"] for r in detection.value_count(n, ["ip"], "port", 60).collect()) == 2
    assert detection.event_count(e.limit(0), ["ip"], 300).count() == 0


def test_alerts_merge_in_order_of_arrival(spark):
    at = lambda i, minutes: ("rule", "r", "s", "g", i, T0 + timedelta(minutes=minutes), None)
    schema = "kind string, rule_id string, source string, group_key string, event_id long, at timestamp, n long"
    rows = [at(1, 0), at(2, 60), at(3, 121), at(4, 10), at(5, 300)]  # the late fourth joins the open alert
    got = sorted((a["first_event"], a["count"]) for a in alerts.dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2), (3, 2), (5, 1)]
    closed = spark.createDataFrame([("rule", "r", "s", "g", 1)], "kind string, rule_id string, source string, group_key string, event_id long")
    got = sorted((a["first_event"], a["count"]) for a in alerts.dedup(spark.createDataFrame(rows, schema), closed=closed).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (5, 1)]


def stats(spark, minutes, lines, parsed, skew=0.0, source="s"):
    rows = [(source, T0 + timedelta(minutes=i), lines, parsed, float(skew * lines), lines if skew else 0) for i in range(minutes)]
    return spark.createDataFrame(rows, "source string, minute timestamp, total long, parsed long, skew_sum double, skew_n long")


@pytest.mark.parametrize(
    "minutes,lines,parsed,skew,wait,thresholds,want,reason",
    [
        (120, 2, 2, 0, 0, None, "ok", ""),
        (120, 2, 2, 0, 45, None, "critical", "silent"),
        (90, 4, 1, 900.0, 0, None, "critical", "parse rate 25 %; clock skew 900 s"),
        (120, 2, 2, 0, 45, {"silence_min_minutes": 120.0}, "ok", ""),
    ],
)
def test_health(spark, minutes, lines, parsed, skew, wait, thresholds, want, reason):
    hosts = spark.createDataFrame([("s", "approved", "json", thresholds), ("quiet", "approved", "json", None)], "source string, status string, format string, thresholds map<string,double>")
    now = F.lit(T0 + timedelta(minutes=minutes + wait))
    got = {r["source"]: r for r in health.status(health.metrics(stats(spark, minutes, lines, parsed, skew), hosts, now)).collect()}
    assert got["s"]["status_now"] == want and "; ".join(got["s"]["reasons"]).startswith(reason)
    assert got["quiet"]["status_now"] == "ok"


def test_health_history_keeps_changes(spark):
    rows = [("s", 1, "ok", []), ("s", 2, "ok", []), ("s", 3, "critical", ["x"]), ("s", 4, "critical", ["x"]), ("s", 5, "critical", ["y"])]
    got = health.history(spark.createDataFrame(rows, "source string, at int, status string, reasons array<string>")).collect()
    assert sorted(r["at"] for r in got) == [1, 3, 5]


def values(path):
    return F.col(f"`{path}`") if path in ("event.action", "source.ip", "event.original") else F.lit(None).cast("array<string>")


@pytest.mark.parametrize(
    "spec,want",
    [
        ({"event.action": "log*"}, True), ({"event.action": "LOGIN"}, True), ({"event.action": "log?n"}, True), ({"event.action": r"log\*"}, False),
        ({"event.action|contains": "ogi"}, True), ({"event.action|re": "^l.*n$"}, True), ({"event.action|re": "^L"}, False), ({"event.action|re|i": "^L"}, True),
        ({"source.ip|cidr": "10.0.0.0/8"}, True), ({"source.ip|cidr": "2001:db8::/32"}, True), ({"source.ip|cidr": "192.0.2.0/24"}, False),
        ({"user.name": None}, True), ({"user.name|exists": False}, True), ({"user.name|exists": True}, False), ({"user.name|contains": "x"}, False),
        (["accepted", "nothing"], True), ({"event.action|contains|all": ["log", "in"]}, True), ({"event.action|gt": 3}, False),
    ],
)
def test_predicates(spark, spec, want):
    doc = spark.createDataFrame([(["login"], ["10.1.2.3", "2001:db8::5"], ["Accepted key for x"])], "`event.action` array<string>, `source.ip` array<string>, `event.original` array<string>")
    assert doc.select(rules.selection(values, spec)).first()[0] is want


@pytest.mark.parametrize("text,want", [("a and not b", True), ("not a or b", False), ("1 of A*", True), ("all of them", False), ("not (a and b)", True), ("any of c*", False)])
def test_conditions(spark, text, want):
    parts = {"a": F.lit(True), "b": F.lit(False), "c1": F.lit(False), "_hidden": F.lit(True)}
    assert spark.range(1).select(rules.condition(text, parts)).first()[0] is want


@pytest.mark.parametrize("text", ["a and", "1 of x*", "a b", "(a", "zz"])
def test_conditions_that_cannot_run(spark, text):
    with pytest.raises(rules.UnsupportedRule):
        rules.condition(text, {"a": F.lit(True)})


def event_row(spark, **fields):
    """One event with fields (a__b for a.b), and its values function."""
    names = {k.replace("__", "."): v for k, v in fields.items()}
    frame = spark.createDataFrame([tuple([v] for v in names.values())], ", ".join(f"`{n}` array<string>" for n in names))
    return frame, lambda path: F.col(f"`{path}`") if path in names else F.lit(None).cast("array<string>")


@pytest.mark.parametrize(
    "source,fields,want",
    [
        ({"category": "firewall"}, {"destination__ip": "10.0.0.1"}, True), ({"category": "firewall"}, {"destination__ip": "10.0.0.1", "dns__question__name": "x.y"}, False),
        ({"category": "firewall"}, {"destination__port": "80", "http__response__status_code": "200"}, False), ({"category": "firewall"}, {"destination__port": "80", "dns": "{}"}, False),
        ({"product": "linux", "service": "sshd"}, {"process__name": "sshd-session"}, True), ({"service": "auth"}, {"process__name": "SSHD"}, True), ({"service": "auth"}, {"process__name": "sudo"}, False),
        ({"service": "cron"}, {"process__name": "crond"}, True), ({"service": "nginx"}, {"url__original": "/"}, True), ({"service": "apache"}, {"process__name": "apache2"}, False),
        ({"service": "syslog"}, {"event__original": "x"}, True), ({"product": "linux"}, {"process__name": "x"}, True), ({"product": "linux"}, {"message": "x"}, False),
        ({"category": "webserver", "product": "windows"}, {"url__path": "/"}, True), ({}, {"message": "x"}, True), (None, {"message": "x"}, True),
        ({"product": "windows"}, {"message": "x"}, "logsource windows"), ({"product": "windows", "service": "sshd"}, {"message": "x"}, "logsource windows"), ({"category": "process_creation"}, {"message": "x"}, "logsource process_creation"),
    ],
)
def test_sources_of_rules(spark, source, fields, want):
    event, values_of = event_row(spark, **fields)
    rule = {"id": "r", "logsource": source, "detection": {"words": ["x"], "not_words": {"|all": ["never seen"]}, "condition": "words or not not_words"}}
    made, refused = rules.compile_rules([rule], values_of)
    assert refused == ({"r": want} if isinstance(want, str) else {})
    if made:
        assert event.select(made[0].test).first()[0] is want
        assert detection.match_rules(event.withColumn("event_id", F.lit(1)), made, ("event_id",)).count() == want


@pytest.mark.parametrize(
    "doc,reason",
    [
        ({"logsource": {"category": "webserver"}, "detection": {"a": {"foo": None}, "condition": "a"}}, "field foo has no path"),
        ({"logsource": {"service": "sshd"}, "detection": {"a": {"user.name": "x"}, "condition": "a"}}, "field user.name has no path"),
        ({"detection": {"a": {"x|gt": "abc"}, "condition": "a"}}, "no number abc"), ({"detection": {"a": {"x|lte": None}, "condition": "a"}}, ""), ({"detection": {"a": {"x|re": "(?P<n>x"}, "condition": "a"}}, "bad pattern (?P<n>x"),
        ({"detection": {"a": {"x|re|i": "a{2"}, "condition": "a"}}, "bad pattern (?i)a{2"), ({"detection": {"a": {"x": "1"}, "timeframe": "1m", "condition": "a"}}, "timeframe"), ({"detection": {"a": {"x": "1"}, "condition": ["a"]}}, ""),
        ({"detection": {"a": {"x": "1"}, "condition": ["a", "a"]}}, "several conditions"), ({"detection": {"a": {"x": "1"}, "condition": []}}, "no condition"), ({"detection": {"a": {"x": "1"}}}, "no condition"),
        ({"detection": {"a": ["w", {"x": "1"}], "condition": "a"}}, "keywords and maps in one selection"), ({"detection": {"a": {"|all|re": ["w"]}, "condition": "a"}}, "keyword modifier re"), ({"detection": {"a": {"|contains|all": ["w"]}, "condition": "a"}}, ""),
        ({"detection": {"a": None, "condition": "a"}}, "selection None"), ({"detection": None}, "no condition"), ({"detection": {"a": {"x": "1"}, "condition": "a | count() > 5"}}, "unexpected |"),
        ({"correlation": {"type": "event_count", "rules": ["r"], "condition": {"gte": 3}}}, ""), ({"correlation": {"type": "event_count", "condition": {"gte": 3}}}, "correlation without rules"),
        ({"correlation": {"type": "value_count", "rules": ["r"], "condition": {"gte": 3}}}, "value_count needs a field"), ({"correlation": {"type": "value_count", "rules": ["r"], "condition": {"gte": 3, "field": "f"}}}, ""),
        ({"correlation": {"type": "event_count", "rules": ["r"], "condition": {"gte": 3, "lt": 4}}}, "correlation needs one comparison"), ({"correlation": {"type": "event_count", "rules": ["r"]}}, "correlation needs one comparison"),
        ({"correlation": {"type": "event_count", "rules": ["r"], "condition": {"eq": 3}, "timespan": "5 minutes"}}, "duration 5 minutes"), ({"correlation": {"type": "temporal_ordered"}}, "correlation temporal_ordered"),
    ],
)
def test_rules_that_cannot_run_say_why(spark, doc, reason):
    assert rules.coverage([{"id": "r"} | doc], lambda path: F.lit(None).cast("array<string>")) == [("r", not reason, reason)]


def test_correlations_as_parameters(spark):
    doc = {"id": "c", "correlation": {"type": "value_count", "rules": ["a"], "group-by": "source.ip", "condition": {"field": "destination.port", "gt": 15}}}
    assert rules.correlation_of(doc) == {"type": "value_count", "rules": ["a"], "group": ["source.ip"], "span": 300, "op": "gt", "limit": 15, "field": "destination.port"}


def test_a_broken_rule_keeps_none_from_running(spark):
    """Hundreds of rules of several kinds of log, some broken: the others match what they should."""
    frame = spark.createDataFrame([(i, [f"v{i}"], ["sshd"] if i % 2 else None, [f"text{i}"]) for i in range(40)], "event_id long, `event.action` array<string>, `process.name` array<string>, `event.original` array<string>")
    names = {"event.action", "process.name", "event.original"}
    docs = [{"id": f"r{i}", "detection": {"a": {"event.action": f"v{i % 40}"}, "condition": "a"}} for i in range(150)]
    docs += [{"id": f"s{i}", "logsource": {"service": "sshd"}, "detection": {"a": [f"text{i}"], "condition": "a"}} for i in range(20)]
    docs += [{"id": f"x{i}", "detection": {"a": {"event.action|re": "(?P<n>v"}, "condition": "a"}} for i in range(5)]
    made, refused = rules.compile_rules(docs, lambda p: F.col(f"`{p}`") if p in names else F.lit(None).cast("array<string>"))
    assert sorted(refused) == [f"x{i}" for i in range(5)]
    got = {(x["rule_id"], x["event_id"]) for x in detection.match_rules(frame, made, ("event_id",)).collect()}
    want = {(f"r{i}", i % 40) for i in range(150)} | {(f"s{i}", e) for i in range(20) for e in range(40) if e % 2 and f"text{e}".startswith(f"text{i}")}
    assert got == want


def test_routing_and_onboarding(spark):
    hosts = spark.createDataFrame([("a", "approved"), ("p", "pending"), ("r", "rejected")], "source string, status string")
    records = spark.createDataFrame(
        [("a", "x", T0, "{}", "p1"), ("a", "x", T0, None, None), ("a", "x", T0, "{}", ""), ("p", "x", T0, "{}", "p1"), ("r", "x", T0, "{}", "p1"), ("new", "x", T0, None, None)],
        "source string, raw string, received_at timestamp, ecs string, parser_id string",
    )
    routed = ingest.route_records(records, hosts)
    assert ingest.route_counts(routed).first().asDict() == {"events": 1, "unparsed": 2, "held": 2, "dropped": 1}
    assert ingest.route_counts(ingest.route_records(records, hosts, auto_approve=True)).first()["held"] == 1
    known = hosts.withColumns({"first_seen": F.lit(T0), "last_seen": F.lit(T0), "lines": F.lit(0).cast("long")})
    assert {r["source"]: r["lines"] for r in ingest.upsert_hosts(known, records).collect()} == {"a": 3, "p": 1, "r": 1, "new": 1}


def test_arrivals_in_two_orders(spark):
    """Counts by blocks, slices and cells against loops: late and equal times, one flooding sender."""
    import random

    import numpy as np

    from logquarry.operators.dominance import arrived_within, count_before

    r = random.Random(6)
    for n in (0, 1, 2, 7, 300):
        a = [np.array([r.randint(0, 20) for _ in range(n)], np.int64) for _ in range(3)]
        ask = [np.array([r.randint(-1, 22) for _ in range(50)], np.int64) for _ in range(2)]
        want = [sum(w for f, s, w in zip(*(x.tolist() for x in a)) if f < i and s <= t) for i, t in zip(*(x.tolist() for x in ask))]
        assert count_before(*a, *ask).tolist() == want
    rows = [(k, 10 * i + r.randint(0, 9), us, us - r.choice([0, 5, 40, 900]), r.random() < 0.8) for k in "ab" for i, us in enumerate(r.choice([i, i - r.randint(0, 60), 30, 1000]) for i in range(400))]
    rows = [(k, j, us, low, asks) for j, (k, _, us, low, asks) in enumerate(r.sample(rows, len(rows)))]
    want = {i: sum(k == p[0] and p[1] <= i and low <= p[2] <= us for p in rows) for k, i, us, low, asks in rows if asks}
    frame = spark.createDataFrame(rows, "k string, id long, us long, low long, asks boolean")
    for block, slices in ((1 << 16, 64), (50, 5), (7, 2)):
        assert {x["id"]: x["n"] for x in arrived_within(frame, ["k"], block, slices).collect()} == want
    # Ids that floating point cannot tell apart.
    big = 1 << 60
    far = spark.createDataFrame([(k, big + i, us, low, asks) for k, i, us, low, asks in rows], frame.schema)
    assert {x["id"] - big: x["n"] for x in arrived_within(far, ["k"], 50, 5).collect()} == want
    # A sender that floods a span, and others, through the operator; both ways give the same.
    flood = [(i, "s", "x" if i % 10 else "y", T0 + timedelta(microseconds=r.randint(0, 4_000_000)), None) for i in range(2500)]
    df = spark.createDataFrame(flood, "event_id long, source string, ip string, at timestamp, port string")
    few, many = ({x["event_id"]: x["n"] for x in detection.live_count(df, ["ip"], 1, few=f).collect()} for f in (3000, 100))
    assert few == many and len(few) == 2500 and max(few.values()) > 500


def test_back_tests_keep_the_first_ids(spark):
    counted = detection.event_count(events(spark, burst(400) + burst(30, "198.51.100.7", 5)), ["ip"], 300)
    whole = {r["ip"]: r for r in detection.best_windows(counted, ["ip"], 300, "gte", 10).collect()}
    few = {r["ip"]: r for r in detection.best_windows(counted, ["ip"], 300, "gte", 10, ids=7).collect()}
    assert {k: (r["n"], r["at"], r["event_ids"][:7]) for k, r in whole.items()} == {k: (r["n"], r["at"], r["event_ids"]) for k, r in few.items()}
    assert len(whole["203.0.113.5"]["event_ids"]) == 301 and len(few) == 2
    plan = detection.best_windows(counted, ["ip"], 300, "gte", 10, ids=7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # no task gets a whole group


def test_folded_stream_is_the_batch(spark, tmp_path):
    """Hits out of order of time, decisions among them, in several batches; with and without counts of their own."""
    import random

    from logquarry.streaming import jobs

    r = random.Random(12)
    schema = "kind string, rule_id string, source string, group_key string, event_id long, at timestamp, n long, ends boolean"
    rows = [("rule", r.choice("xy"), "s", r.choice("gh"), i, T0 + timedelta(minutes=r.choice([i * 7, i * 7 - 300, 0])), r.choice([None, None, i]), i % 9 == 4) for i in range(240)]
    for k in range(6):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = jobs.run_once(jobs.alert_fold_stream(stream.where("not ends").drop("ends"), 60, stream.where("ends")), f"file://{tmp_path}/out", "update")
    assert found.select("batch").distinct().count() == 6
    frame = spark.createDataFrame(rows, schema)
    want = alerts.dedup(frame.where("not ends").drop("ends"), 60, frame.where("ends").select(*alerts.KEY, "event_id"))
    columns = [*alerts.KEY, "alert_no", "first_seen", "last_seen", "count", "first_event"]
    got = sorted(map(str, (tuple(x[c] for c in columns) for x in jobs.latest(found, [*alerts.KEY, "alert_no"]).collect())))
    assert got == sorted(map(str, (tuple(x[c] for c in columns) for x in want.collect()))) and len(got) > 40
    again = jobs.run_once(jobs.alert_fold_stream(stream.where("not ends").drop("ends"), 60, stream.where("ends")), f"file://{tmp_path}/out", "update")
    assert again.count() == found.count()


def routed_of(spark, folder):
    from logquarry.sources.batches import BatchStore

    return BatchStore(spark, f"file://{folder}/store")


@pytest.mark.parametrize("dies", [None, "lines", "hosts", "mark", "checkpoint"])
def test_a_routed_stream_can_be_replayed(spark, tmp_path, monkeypatch, dies):
    """A run that dies in its second batch, at any place, and is run again ends like one that does not."""
    from logquarry.sources.batches import BatchStore
    from logquarry.streaming import jobs

    hosts = spark.createDataFrame([("a", "approved"), ("p", "pending"), ("r", "rejected")], "source string, status string")
    schema = "event_id long, source string, raw string, received_at timestamp, ecs string, parser_id string, skew double"
    rows = [(i, "aprn"[i % 4], f"l{i}", T0 + timedelta(seconds=20 * i), "{}" if i % 3 else None, "p1", 1.5 if i % 5 == 0 else None) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store, calls = routed_of(spark, tmp_path), []
    run = lambda: jobs.route_to(stream(), hosts, store, f"{tmp_path}/checkpoint", key="event_id")
    put, commit = BatchStore.put, BatchStore.commit

    def failing_put(self, number, table, frame, by=()):
        out = put(self, number, table, frame, by)
        if number == 1 and table == dies and not calls:
            calls.append(1)
            raise RuntimeError("the run dies")
        return out

    def failing_commit(self, number):
        if number == 1 and dies == "mark" and not calls:
            calls.append(1)
            raise RuntimeError("the run dies")
        commit(self, number)
        if number == 1 and dies == "checkpoint" and not calls:
            calls.append(1)
            raise RuntimeError("the run dies")

    monkeypatch.setattr(BatchStore, "put", failing_put)
    monkeypatch.setattr(BatchStore, "commit", failing_commit)
    if dies:
        with pytest.raises(Exception):
            run()
        assert store.numbers() == ([0, 1] if dies == "checkpoint" else [0])
    run()
    assert store.numbers() == [0, 1, 2] and bool(calls) == bool(dies)
    want = ingest.route_records(spark.createDataFrame(rows, schema), hosts)
    plain = lambda frame, *columns: sorted(map(str, (tuple(r) for r in frame.select(*columns).collect())))
    columns = ("event_id", "source", "raw", "received_at", "ecs", "parser_id", "skew", "held", "route")
    assert plain(jobs.routed_lines(store, "event_id long"), *columns) == plain(want.where("route <> 'dropped'"), *columns)
    counters = ("source", "minute", "total", "parsed", "skew_sum", "skew_n")
    assert plain(ingest.merge_counters(store.read("counters", jobs.COUNTER_GAINS)), *counters) == plain(ingest.minute_stats(want), *counters)
    known = hosts.withColumns({"first_seen": F.lit(T0), "last_seen": F.lit(T0), "lines": F.lit(7).cast("long")})
    of_host = ("source", "status", "first_seen", "last_seen", "lines")
    assert plain(jobs.host_gains(store, known), *of_host) == plain(ingest.upsert_hosts(known, spark.createDataFrame(rows, schema)), *of_host)


def late_rows(seed, n, late):
    """Matches in order of arrival whose times lag behind by up to late minutes: (event_id, source, ip, at, port)."""
    import random

    r = random.Random(seed)
    return [(i, r.choice("ab"), r.choice(["x", "x", "y", None]), T0 + timedelta(seconds=10 * i, minutes=-r.choice([0, 0, r.randint(0, late)])), r.choice(["1", "2", "3", None])) for i in range(n)]


def live_brute(rows, span, of=None):
    """How many matches, or values of one column, each match can see of those that came before it."""
    out = {}
    for at, e in enumerate(rows):
        seen = [p for p in rows[: at + 1] if p[1:3] == e[1:3] and e[3] - timedelta(seconds=span) <= p[3] <= e[3]]
        out[e[0]] = len({p[of] for p in seen}) if of else len(seen)
    return {e[0]: out[e[0]] for e in rows if e[2]}


@pytest.mark.parametrize("dies", [None, "instants", "arrivals", "counts", "mark"])
def test_correlation_by_tables_counts_late_rows_and_can_be_replayed(spark, tmp_path, monkeypatch, dies):
    from logquarry.sources.batches import BatchStore
    from logquarry.streaming import jobs

    schema = "event_id long, source string, ip string, at timestamp, port string"
    rows = late_rows(5, 120, 4000)
    rows = [((x[0] * 7919) % 120 + 120 * (k // 40), *x[1:]) for k, x in enumerate(rows)]  # ids rise from batch to batch only
    rows = [x for k in range(3) for x in sorted(rows[40 * k : 40 * k + 40])]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store, calls = routed_of(spark, tmp_path), []
    run = lambda: jobs.correlate_to(stream(), ["ip"], 900, store, f"{tmp_path}/checkpoint")
    put, commit = BatchStore.put, BatchStore.commit

    def failing_put(self, number, table, frame, by=()):
        out = put(self, number, table, frame, by)
        if number == 1 and table == dies and not calls:
            calls.append(1)
            raise RuntimeError("the run dies")
        return out

    def failing_commit(self, number):
        if number == 1 and dies == "mark" and not calls:
            calls.append(1)
            raise RuntimeError("the run dies")
        commit(self, number)

    monkeypatch.setattr(BatchStore, "put", failing_put)
    monkeypatch.setattr(BatchStore, "commit", failing_commit)
    if dies:
        with pytest.raises(Exception):
            run()
        assert store.numbers() == [0]
    run()
    got = [(x["event_id"], x["n"]) for x in jobs.correlated(store, stream(), ["ip"]).collect()]
    assert sorted(got) == sorted(live_brute(rows, 900).items()) and max(n for _, n in got) > 5
    assert store.numbers() == [0, 1, 2] and bool(calls) == bool(dies)
    left = [p.name for p in (tmp_path / "store").iterdir()]
    assert not any(list((tmp_path / "store" / t).iterdir()) for t in ("matches", "arrivals") if t in left)


def test_correlation_by_state_counts_matches_and_values(spark, tmp_path):
    """Matches out of order within what the watermark can reach, in several batches."""
    from logquarry.streaming import jobs

    schema = "event_id long, source string, ip string, at timestamp, port string"
    rows = late_rows(6, 150, 40)
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").where("ip is not null")
    for field, of in ((None, None), ("port", 4)):
        found = jobs.run_once(jobs.correlation_stream(stream, ["ip"], 300, "1 hour", field), f"file://{tmp_path}/{field}", "update")
        assert sorted((x["event_id"], x["n"]) for x in found.collect()) == sorted(live_brute(rows, 300, of).items())
        assert found.select("batch").distinct().count() == 3


def test_backfill_mends_counters_once(spark, tmp_path):
    store = routed_of(spark, tmp_path)
    at = lambda m: T0 + timedelta(minutes=m)
    lines = spark.createDataFrame([(i, "s", at(i // 4), f"l{i}", i == 9) for i in range(10)] + [(10, "t", at(0), "x", False)], "line_id long, source string, received_at timestamp, raw string, held boolean")
    parsed = spark.createDataFrame([(i, "doc" if i != 5 else None, at(i // 4) - timedelta(seconds=3) if i % 2 else None) for i in range(11)], "line_id long, doc string, event_at timestamp")
    counters = spark.createDataFrame([("s", at(m), 4, 0, 0.5, 1) for m in range(2)], "source string, minute timestamp, total long, parsed long, skew_sum double, skew_n long")
    ingest.run_backfill(store, 0, lines.where("line_id < 6"), parsed)
    ingest.run_backfill(store, 1, lines, parsed)
    for run in (0, 1, 2):  # the first two again, and one that finds nothing new
        ingest.run_backfill(store, run, lines, parsed)
    moved = store.read("events", ingest.MOVED).collect()
    assert sorted(r["line_id"] for r in moved) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    mended = ingest.mend_counters(counters, store.read("counters", ingest.GAINED)).orderBy("minute").collect()
    # Minute 2 and the sender t have no counter, so they gain none.
    assert [(r["source"], r["total"], r["parsed"], r["skew_sum"], r["skew_n"]) for r in mended] == [("s", 4, 4, 6.5, 3), ("s", 4, 3, 3.5, 2)]
    twice = spark.createDataFrame(moved[:1] * 2, store.read("events", ingest.MOVED).schema)
    assert ingest.backfill_counters(twice).first()["parsed"] == 1
    assert ingest.mend_counters(counters, ingest.backfill_counters(twice.limit(0))).count() == 2


def test_refused_envelopes(spark):
    lines = ['{"message": "m", "source": "s"}', "", '[{"message": "a"}, {"message": "b"}]', '{"message": 5}', "{broken", '{"message": "m"} x', '[{"message": "a"}, {"message": null}]']
    from logquarry.sources.records import read_ndjson

    good, bad = read_ndjson(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r["source"], r["raw"]) for r in good.collect()) == [("s", "m"), ("unknown", "a"), ("unknown", "b")]
    assert bad.count() == 4


def test_envelopes_with_braces(spark):
    from logquarry.sources.records import read_ndjson

    kept = ['{"message":"f{a}{b}","source":"x"}', '{"message":"} {","source":"x"}', ' [{"message":"}{ ]["}] \t', '{"message":"q","source":"","ecs":5}', '{"message":"e","ecs":{"a":{"b":1}}}', '[]', '{"message":"\\u007d\\u007b"}']
    lost = ['{"message":"m"} {"message":"n"}', '{"message":"m"}{"message":"n"}', '{"message":"m"}, {"message":"n"}', '{"message":"m"}] [', '[{"message":"m"}] []', '"m"', '5', '{"message":"m"},', '{"message":"a","message":"b"}', '}{', '[[{"message":"m"}]]', 'null']
    good, bad = read_ndjson(spark.createDataFrame([(x,) for x in kept + lost], "value string"))
    got = sorted((r["source"], r["raw"], r["ecs"]) for r in good.collect())
    assert got == sorted([("x", "f{a}{b}", None), ("x", "} {", None), ("unknown", "}{ ][", None), ("unknown", "q", None), ("unknown", "e", '{"a":{"b":1}}'), ("unknown", "}{", None)], key=lambda r: (r[0], r[1]))
    assert sorted(r["value"] for r in bad.collect()) == sorted(lost)


def test_originals_with_any_sign_come_back(spark):
    """Values with signs that mean something in replacements, and values that look like tokens of others."""
    values_ = [("user", "svc$"), ("user", "a$1b"), ("user", "DOM\\bob"), ("user", "x\\"), ("user", "$0"), ("ipv4", "10.5.6.7"), ("ipv4", "10.5.6.8"), ("user", "(a|b)*"), ("fqdn", "h1.corp.lan"), ("email", "a@h1.corp.lan")]
    vault = pseudonyms.build_vault(spark.createDataFrame(values_, "kind string, value string"), KEY, b"k" * 16)
    tokens = {r["v"]: r["token"] for r in vault.select("token", F.aes_decrypt("enc", F.lit(b"k" * 16)).cast("string").alias("v")).collect()}
    # One value's token is another's original.
    odd = vault.unionByName(vault.limit(1).select("kind", F.lit("d").alias("digest"), F.lit(tokens["a$1b"].replace("user-", "host-")).alias("token"), "salt", "collided", F.aes_encrypt(F.lit(tokens["svc$"]), F.lit(b"k" * 16)).alias("enc")))
    lines = [(i, f"{tokens[v]}: <{tokens[v].upper()}> and {tokens['svc$']}", f"{v}: <{v}> and svc$") for i, (_, v) in enumerate(values_)]
    lines += [(100, tokens["a$1b"].replace("user-", "host-") + " stays once", tokens["svc$"] + " stays once"), (101, "user-zzzzzz 10.1.1.1 none", "user-zzzzzz 10.1.1.1 none"), (102, None, None), (103, "", "")]
    back = pseudonyms.reidentify(spark.createDataFrame([x[:2] for x in lines], "line_id long, text string"), "text", odd, b"k" * 16)
    assert {r["line_id"]: r["text"] for r in back.collect()} == {i: want for i, _, want in lines}
    done = pseudonyms.pseudonymise_doc(spark.createDataFrame([(1, "user.name", "bob"), (1, "message", "bob and BOB")], "doc_id long, path string, value string"), KEY)
    assert {r["path"]: r["value"] for r in done.collect()}["message"] == f"{tokens_of(spark, 'user', 'bob')} and {tokens_of(spark, 'user', 'bob')}"


def tokens_of(spark, kind, value):
    return spark.range(1).select(pseudonyms.token(KEY, F.lit(kind), F.lit(value))).first()[0]


MAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\b", re.A)


def test_mail_addresses_as_columns(spark):
    import random

    r = random.Random(7)
    texts = ["a@b.com, a@b.com.123 x.y@z.org. u@h-1.example.net-x é@b.de a@b.c a@b..com @b.com a@ a@b a@b.co1 z@-.com"]
    texts += ["".join(r.choice("aB1.- _%é") for _ in range(r.randint(0, 40))) + "@" + "".join(r.choice(["ab", "c", ".", ".com", "-", "1"]) for _ in range(r.randint(0, 8))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in frame.select("i", pseudonyms.detect_simple(F.col("t"), "email").alias("v")).collect():
        assert sorted(x["v"]) == sorted({m[0] for m in MAIL.finditer(texts[x["i"]])}), texts[x["i"]]
    long = "a@" + "label." * 100_000 + "com " + "x." * 100_000 + "@" + "y-" * 100_000
    got = spark.createDataFrame([(long,)], "t string").select(pseudonyms.detect_simple(F.col("t"), "email").alias("v")).first()["v"]
    assert [len(v) for v in got] == [len("a@") + 600_003]


def test_counts_and_alerts_by_stretches_of_time(spark):
    """Windows and islands across the edges of stretches and blocks, against loops over all rows."""
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice(["x", "y", None]), T0 + timedelta(seconds=r.randint(0, 900), microseconds=r.choice([0, 0, 1])), r.choice(["1", "2", "3", None])) for i in range(250)]
    df = spark.createDataFrame(rows, "event_id long, source string, ip string, at timestamp, port string")
    span = timedelta(seconds=60)
    past = {e[0]: [p for p in rows if p[1:3] == e[1:3] and e[3] - span <= p[3] <= e[3]] for e in rows if e[2]}
    for found, want in (
        (detection.event_count(df, ["ip"], 60), {i: len(p) for i, p in past.items()}),
        (detection.value_count(df, ["ip"], "port", 60), {i: len({x[4] for x in p}) for i, p in past.items()}),
        (detection.live_count(df, ["ip"], 60), {i: sum(x[0] <= i for x in p) for i, p in past.items()}),
    ):
        assert sorted((x["event_id"], x["n"]) for x in found.collect()) == sorted(want.items())
    hits = df.select(F.lit("rule").alias("kind"), F.lit("r").alias("rule_id"), "source", F.col("ip").alias("group_key"), "event_id", "at", F.lit(None).cast("long").alias("n"))
    closed = hits.where("event_id % 40 = 7").drop("at", "n")
    columns = [*alerts.KEY, "alert_no", "first_seen", "last_seen", "count", "first_event"]
    for marks in (None, closed):
        whole, cut = (sorted((tuple(x[c] for c in columns) for x in alerts.dedup(hits, 1, marks, block).collect()), key=str) for block in (1 << 20, 9))
        assert whole == cut and len(whole) > 20
    open_, want = {}, []
    for i, source, ip, at, _ in rows:  # one after the other
        last = open_.get((source, ip))
        if last and at - timedelta(minutes=1) <= last[1]:
            last[1], last[2] = max(last[1], at), last[2] + 1
        else:
            open_[source, ip] = last = [i, at, 1]
            want.append(last)
    assert sorted((x["first_event"], x["last_seen"].replace(tzinfo=timezone.utc), x["count"]) for x in alerts.dedup(hits, 1, None, 9).collect()) == sorted(map(tuple, want))


LINES = {
    "dns query from anna-pc to nas.home.lan": ["fqdn:nas.home.lan"],
    'devname="fw-edge" srcip=192.0.2.44 user="j.doe" action=deny': ["host:fw-edge", "ipv4:192.0.2.44", "user:j.doe"],
    r"C:\Users\mmeier\file S-1-5-21-1-2-3-1104": ["sid:S-1-5-21-1-2-3-1104", "user:mmeier"],
    "Failed password for invalid user bob from 2001:db8::7 port 22 mac 00:1b:44:11:3a:b7": ["ipv6:2001:db8::7", "mac:00:1b:44:11:3a:b7", "user:bob"],
    "mail for info@corp.example.com": ["email:info@corp.example.com"],
    "System.Management.Automation.dll loaded app.log 127.0.0.1 224.0.0.1": [],
    "user-0a1b2c logged in": [],
}
MORE_LINES = {
    r"logon of CORP\ahuber and CORP\admins\bkurz": ["user:ahuber", "user:bkurz"],
    'web7.lan - jroth [10/Oct/2024:13:55:36 +0200] "GET / HTTP/1.1" 200 5': ["fqdn:web7.lan", "user:jroth"],
    'edge4 idmeier - [10/Oct/2024:13:55:36 +0200] "GET /" 200 5': ["host:edge4", "user:idmeier"],
    "<189>core-sw1 %LINK-3-UPDOWN: up": ["host:core-sw1"],
    "<34>Oct 11 22:14:15 mymachine su: opened": ["host:mymachine"],
    "<165>1 2024-10-11T22:14:15.003Z relay9 app 1 ID - x": ["host:relay9"],
    "Oct  1 2024 22:14:15 gate: authentication failure for cvogel": ["host:gate", "user:cvogel"],
    "denied user 'dlang' and user <elorenz>, username 'fbraun'": ["user:dlang", "user:elorenz", "user:fbraun"],
    "Accepted publickey for gkaiser; session opened for user hbusch; by user ikoch; illegal user jfuchs": ["user:gkaiser", "user:hbusch", "user:ikoch", "user:jfuchs"],
    "sudo:   klutz : TTY=pts/0": ["user:klutz"],
    "(C:\\\\Users\\\\Public) a/home/pohl file:/Users/nott/x": ["user:nott"],
    "cat /home/lmaurer/x": ["user:lmaurer"],
    "xauthuser=moser remuser: nagel client_name=pc-77 dvc_host=fw-3 srcname=\"nas 2\" dst_user_name=opitz uid=0": ["host:fw-3", "host:nas 2", "host:pc-77", "user:moser", "user:nagel", "user:opitz"],
    "outside:2a02:810d::1/443 seen, key aa:bb:cc:dd:ee:ff:00:11": ["ipv6:2a02:810d::1"],
    "src.user=bobby dst.host: box7 a/b.user='carl x' login='dora\" x/user=emil1": ["host:box7", "user:bobby", "user:carl x", "user:dora", "user:emil1"],
    "src_user=frank my-user=nobody2 http.host=web.lan srv.host=web.example.org": ["fqdn:web.example.org", "fqdn:web.lan", "user:frank"],
    "GET https://Intra.Example.ORG:8443/a?b std::vector 10.1.2.3:80, 10.1.2.300": ["fqdn:Intra.Example.ORG", "ipv4:10.1.2.3"],
}


@pytest.mark.parametrize("line,want", [*LINES.items(), *MORE_LINES.items()])
def test_entities(line, want):
    assert sorted(f"{k}:{v}" for k, _, _, v in ent.detect(line)) == want


def test_pseudonyms_keep_shape_and_leak_nothing(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_id long, line string")
    done = pseudonyms.pseudonymise_text(lines, "line", KEY).collect()
    for r in done:
        for f in r["found"]:
            assert f["value"].lower() not in r["outgoing"].lower().replace(f["token"].lower(), "")
            shape = {"ipv4": r"(198\.1[89]|10\.\d+)(\.\d+){2,3}", "mac": r"02(:[0-9a-f]{2}){5}", "user": "user-[0-9a-f]{6}", "host": "host-[0-9a-f]{6}", "sid": r"S-1-5-21-\d+-\d+-\d+-1104",
                     "email": r"u[0-9a-f]{6}@d[0-9a-f]{6}\.d[0-9a-f]{6}\.com", "fqdn": r"(d[0-9a-f]{6}\.)+lan", "ipv6": "2001:db8:.*"}
            assert re.fullmatch(shape[f["kind"]], f["token"])
    again = {r["line_id"]: r["outgoing"] for r in pseudonyms.pseudonymise_text(lines, "line", KEY).collect()}
    assert again == {r["line_id"]: r["outgoing"] for r in done}
    vault = pseudonyms.build_vault(spark.createDataFrame([(f["kind"], f["value"]) for r in done for f in r["found"]], "kind string, value string"), KEY, b"k" * 16)
    back = pseudonyms.reidentify(spark.createDataFrame([(r["line_id"], r["outgoing"]) for r in done], "line_id long, text string"), "text", vault, b"k" * 16)
    assert {r["line_id"]: r["text"] for r in back.collect()} == {i: x for i, x in enumerate(LINES)}


def test_values_of_one_token_come_back_through_the_vault(spark):
    """anna2918 and anna509 have one token of six digits: only the vault's tell them apart."""
    key = b"a key for test tables"
    texts = ["user=anna2918 host=box1 src=10.9.118.7", "Failed password for anna509 from 10.9.109.7 port 22", "user=Anna2918 user=anna509 by anna2918", "nothing", None]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    assert len({r[0] for r in spark.createDataFrame([("anna2918",), ("anna509",)], "v string").select(pseudonyms.token(key, F.lit("user"), F.col("v"))).collect()}) == 1
    found = pseudonyms.with_found(lines, "line", key).select(F.explode("found").alias("f")).select("f.kind", "f.value")
    vault = pseudonyms.build_vault(found, key, b"k" * 16)
    done = pseudonyms.pseudonymise_text(lines, "line", key, vault=vault)
    back = pseudonyms.reidentify(done.select("line_id", F.col("outgoing").alias("text")), "text", vault, b"k" * 16)
    assert {r["line_id"]: (r["text"] or "").lower() for r in back.collect()} == {i: (x or "").lower() for i, x in enumerate(texts)}


def test_colliding_tokens_get_salts(spark):
    found = spark.createDataFrame([("user", f"u{i}") for i in range(60)], "kind string, value string")
    vault = pseudonyms.build_vault(found, KEY, b"k" * 16, width=1, rounds=4).collect()
    assert len(vault) == 60 and max(r["salt"] for r in vault) > 0 and sum(r["collided"] for r in vault) >= 44
    few = pseudonyms.build_vault(found.limit(14), KEY, b"k" * 16, width=1).collect()  # of 16 tokens
    assert len({r["token"] for r in few}) == 14 and not any(r["collided"] for r in few)


def test_salts_are_places_among_values_of_one_token(spark):
    """Values that meet a token with their salt, too, keep the salt and get a token of their own."""
    import collections

    rows = spark.createDataFrame([("user", f"u{i}") for i in range(150)], "kind string, value string")  # of 256 tokens
    plain = {r["d"]: r["t"] for r in rows.select(pseudonyms.digest(KEY, F.col("kind"), F.col("value")).alias("d"), pseudonyms.token(KEY, F.col("kind"), F.col("value"), width=2).alias("t")).collect()}
    shared = collections.defaultdict(list)
    for d in sorted(plain):
        shared[plain[d]].append(d)
    vault = pseudonyms.build_vault(rows, KEY, b"k" * 16, width=2).collect()
    assert {r["digest"]: r["salt"] for r in vault} == {d: i for ds in shared.values() for i, d in enumerate(ds)}
    assert len({r["token"] for r in vault}) == 150 and not any(r["collided"] for r in vault)
    assert all(r["token"] == plain[r["digest"]] for r in vault if r["salt"] == 0)


def test_salts_of_an_extended_vault(spark, tmp_path):
    """New values count behind what salts have made of earlier ones, whatever tokens these were given in the end."""
    import collections

    path = f"file://{tmp_path}/vault"
    frame = lambda rows: spark.createDataFrame([("user", f"u{i}") for i in rows], "kind string, value string")
    plain = {r["d"]: r["t"] for r in frame(range(160)).select(pseudonyms.digest(KEY, F.col("kind"), F.col("value")).alias("d"), pseudonyms.token(KEY, F.col("kind"), F.col("value"), width=2).alias("t")).collect()}
    for rows in (range(80), range(160)):
        pseudonyms.extend_vault(frame(rows), path, KEY, b"k" * 16, width=2)
    vault = pseudonyms.open_vault(spark, path).collect()
    held = {r["by_salt"] for r in vault if r["batch"] == 0}
    for batch in (0, 1):
        shared = collections.defaultdict(list)
        for d in sorted(r["digest"] for r in vault if r["batch"] == batch):
            shared[plain[d]].append(d)
        assert {r["digest"]: r["salt"] for r in vault if r["batch"] == batch} == {d: i + (batch and t in held) for t, ds in shared.items() for i, d in enumerate(ds)}
    assert len({r["token"] for r in vault}) == len(vault) == 160 > len({r["by_salt"] for r in vault})


def test_a_vault_only_grows(spark, tmp_path):
    """Values come in batches under tokens of two digits: what was given out stays, and nothing is given twice."""
    import shutil

    path, secret, first = f"file://{tmp_path}/vault", b"k" * 16, {}
    names = [("user", f"u{i}") for i in range(120)] + [("host", f"u{i}") for i in range(60)]
    steps = [names[:60], names[:60], names[100:180] + [("user", "U3")], names]
    for n, rows in enumerate(steps):
        assert pseudonyms.extend_vault(spark.createDataFrame(rows, "kind string, value string"), path, KEY, secret, width=2) == n
        vault = pseudonyms.open_vault(spark, path).collect()
        now = {(r["kind"], r["digest"]): (r["token"], bytes(r["enc"]), r["salt"], r["batch"]) for r in vault}
        assert len(now) == len(vault) == len({k for s in steps[: n + 1] for k in ((kind, v.lower()) for kind, v in s)})
        assert len({t[0] for t in now.values()}) == len(now) and now.items() >= first.items()
        first = now
    assert max(t[2] for t in first.values()) > 0 and {t[3] for t in first.values()} == {0, 2, 3}
    back = pseudonyms.open_vault(spark, path).select("kind", F.aes_decrypt("enc", F.lit(secret)).cast("string")).collect()
    assert {(r[0], r[1].lower()) for r in back} == set(names)
    # A lost run leaves rows without a mark: they do not count, and the next run replaces them.
    shutil.copytree(tmp_path / "vault/rows/batch=0", tmp_path / "vault/rows/batch=4")
    assert pseudonyms.open_vault(spark, path).count() == len(first)
    with pytest.raises(ValueError):  # 256 tokens for each kind
        pseudonyms.extend_vault(spark.createDataFrame([("user", f"w{i}") for i in range(300)], "kind string, value string"), path, KEY, secret, width=2, rounds=3)
    assert {(r["kind"], r["digest"]) for r in pseudonyms.open_vault(spark, path).collect()} == set(first)
    assert pseudonyms.extend_vault(spark.createDataFrame([("user", "last")], "kind string, value string"), path, KEY, secret, width=2) == 4
    assert pseudonyms.open_vault(spark, path).count() == len(first) + 1


def test_hmac_and_addresses(spark):
    import hashlib
    import hmac
    import ipaddress

    row = spark.range(1).select(hmac_hex(KEY, "a", F.lit("é")).alias("h"), ipv6_digits(F.lit("2001:DB8::1:0")).alias("d"), ipv6_digits(F.lit("1::2::3")).alias("x"), in_network(F.lit("10.0.0.256"), "10.0.0.0/8").alias("n")).first()
    assert row["h"] == hmac.new(KEY, "a\0é".encode(), hashlib.sha256).hexdigest()
    assert row["d"] == ipaddress.IPv6Address("2001:db8::1:0").exploded.replace(":", "") and row["x"] is None and row["n"] is False


def test_known_values_in_one_pass():
    """Ten thousand value rules together find what each would find by itself."""
    import random
    import time

    r = random.Random(2)
    values_ = sorted({"".join(r.choice("ab1._-é ") for _ in range(r.randint(2, 6))).strip() for _ in range(300)} - {""})
    rules_ = [("value", r.choice(["user", "host"]), v) for v in values_] + [("value", "host", values_[0]), ("regex", "user", r"on (\w+)")]
    extra, known = pseudonyms.rule_sets(rules_)
    assert len(extra) == 1 and len(known) == len(values_) + 1
    slow = [(k, re.compile(pseudonyms.rule_pattern(t, p))) for t, k, p in rules_]
    fast, one = ent.Literals(known), [(k, re.compile(p)) for k, p in extra]
    texts = ["".join(r.choice("ab1._-é ,=") for _ in range(r.randint(0, 60))) for _ in range(300)]
    assert all(ent.detect(t, one, fast) == ent.detect(t, slow) for t in texts)
    many = ent.Literals([("user", f"person{i}") for i in range(10_000)])
    line = "nothing here but person9999 and person77 and xperson5 " * 20
    began = time.perf_counter()
    found = ent.detect(line, (), many)
    assert {v for _, _, _, v in found} == {"person9999", "person77"} and time.perf_counter() - began < 1


def test_grounding_values_without_a_whole_word(spark):
    lines = [("s", 1, "x a+b/c y"), ("s", 2, "x A+B/C y"), ("s", 3, "x a+b y"), ("t", 4, "x a+b/c y"), ("s", 5, "k=§§a"), ("s", 6, "")]
    candidates = [("s", "a+b/c", "user"), ("s", "+b", "user"), ("s", "§§a", "host"), ("s", "q+r+s", "user"), ("t", "a+", "host")]
    got = pseudonyms.ground_candidates(spark.createDataFrame(candidates, "source string, value string, kind string"), spark.createDataFrame(lines, "source string, line_id long, line string")).collect()
    assert sorted((r["source"], r["value"], r["lines"]) for r in got) == [("s", "+b", 3), ("s", "a+b/c", 2), ("s", "§§a", 1), ("t", "a+", 1)]


def test_learned_rules_refused(spark):
    rows = [("1", "key", "user", "suser"), ("2", "key", "user", "msg"), ("3", "regex", "user", "(a+)+"), ("4", "regex", "user", "(a)(b)"), ("5", "regex", "host", r"on (\w+)"), ("6", "value", "planet", "abc")]
    got = {r["rule_id"]: r["refused"] for r in pseudonyms.validate_rules(spark.createDataFrame(rows, "rule_id string, rtype string, kind string, pattern string")).collect()}
    assert got == {"1": None, "2": "generic key", "3": "nested quantifier", "4": "groups", "5": None, "6": "kind"}


def test_spec_takes_the_first_shape(spark):
    spec = op_spec = parsing.Spec(shapes=(parsing.Shape(r"^a(?P<n>\d+)", {"event.code": "n"}), parsing.Shape(r"^a(?P<n>.*)", {"event.action": "n"})))
    doc, _ = parsing.parse(op_spec, F.col("line"))
    got = [r["d"] for r in spark.createDataFrame([("a12",), ("abc",), ("x",), (None,)], "line string").select(doc.alias("d")).collect()]
    assert got == [{"event.code": "12"}, {"event.action": "bc"}, None, None] and spec.shapes


@pytest.mark.parametrize("text,fmt,want", [("Feb  3 04:05:06", "%b %d %H:%M:%S", "2024-02-03 04:05:06"), ("03/Feb/2024:04:05:06 +0200", "%d/%b/%Y:%H:%M:%S %z", "2024-02-03 02:05:06"), ("1706933106", "%s", "2024-02-03 04:05:06"), ("soon", "%Y-%m-%d", None)])
def test_times(spark, text, fmt, want):
    got = spark.range(1).select(F.date_format(parsing.prefix_time(F.lit(text), fmt, 2024), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def test_field_scores(spark):
    side = lambda rows: spark.createDataFrame(rows, "doc_id int, field string, values array<string>")
    expected = side([(1, "a", ["1"]), (1, "b", ["2"]), (1, "c", ["3"])])
    same = scoring.field_f1(expected, expected).first()
    assert same["f1"] == 1.0
    off = scoring.field_f1(side([(1, "a", ["1"]), (1, "b", ["2", "9"]), (1, "c", ["x"])]), expected).first()
    assert (off["tp"], off["fp"], off["fn"]) == (2, 1, 1)
    assert scoring.field_f1(expected.limit(0), expected).first()["recall"] == 0.0


def test_leaves_of_documents(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": [1, 2], "c": null}, "d": "x", "e": true}'), (2, "{"), (3, None)], "doc_id int, doc string")
    assert sorted((r["path"], r["value"]) for r in leaves(docs, "doc").collect()) == [("a.b", "1"), ("a.b", "2"), ("d", "x"), ("e", "true")]


def test_lines_meet_candidates_by_few_words(spark):
    """Words and runs that no candidate of the sender has are left out before anything is joined; none that one has."""
    texts = [(f"s{i % 3}", i, f"word{i} other{i * 7} from name{i % 50} to port 22") for i in range(600)]
    lines = spark.createDataFrame(texts, "source string, line_id long, line string")
    keys = spark.createDataFrame([(f"s{i % 3}", f"name{i % 50}") for i in range(150)], "source string, w string")
    words = lines.select("source", F.explode(pseudonyms._marked(F.split("line", " "), pseudonyms._marks(keys, "source", "w"), "source")).alias("w"))
    assert words.where("w like 'name%'").count() == 600 and words.count() < 650  # 4,200 with all of them
    assert lines.select(F.size(pseudonyms._marked(F.split("line", " "), pseudonyms._marks(keys.limit(0), "source", "w"), "source")).alias("n")).agg(F.sum("n")).first()[0] == 0
    named = [(s, v, "user") for s in ("s0", "s1", "s2") for v in [*(f"name{i}" for i in range(50)), "nobody", "port 22", "to port"]]
    got = {(r["source"], r["value"]): r["lines"] for r in pseudonyms.ground_candidates(spark.createDataFrame(named, "source string, value string, kind string"), lines).collect()}
    want = {}
    for s, _, t in texts:
        for v in {t.split()[3], "port 22", "to port"}:
            want[s, v] = want.get((s, v), 0) + 1
    assert got == want


def test_templates_mask_what_varies(spark):
    rows = [("s", i, f"user {n} logged in from 10.0.0.{i}") for i, n in enumerate(["anna", "bob", "anna", "carl"])] + [("s", 9, "disk full")]
    got = {r["template"]: r["size"] for r in parsing.templates(spark.createDataFrame(rows, "source string, line_no int, line string")).collect()}
    assert got == {"user <*> logged in from <*>": 4, "disk full": 1}
    # The first two share their last words only, the third has a word of its own everywhere.
    rows = [("s", 0, "alpha port is now down"), ("s", 1, "beta port is now down"), ("s", 2, "gamma fan was here today"), ("t", 3, "alpha port is now down")]
    got = {(r["source"], r["template"]): r["size"] for r in parsing.templates(spark.createDataFrame(rows, "source string, line_no int, line string")).collect()}
    assert got == {("s", "<*> port is now down"): 2, ("s", "gamma fan was here today"): 1, ("t", "alpha port is now down"): 1}


def clusters_brute(forms, near, heads):
    """The leader of each form {(source, masked): n} that has a group, one meeting after the other."""
    import math
    import re

    words = {f: f[1].split(" ") for f in forms}
    named = {f: [x for x in enumerate(w) if re.search("[A-Za-z]", x[1])] or list(enumerate(w)) for f, w in words.items()}
    shared = lambda f, g: sum(a == b != "<*>" for a, b in zip(words[f], words[g]))
    plain = lambda f: sum(w != "<*>" for w in words[f])
    like = lambda f, g: shared(f, g) >= max(1, math.ceil(near * max(plain(f), plain(g))))
    group, led, quiet, turn = {}, set(), 0, 0
    while quiet < 4:
        p, meetings, joins = turn % 4, {}, {}
        for f in forms:
            at = named[f][[0, -1, 1, len(named[f]) // 2][p]] if p != 2 or len(named[f]) > 1 else None
            if at and group.get(f, f) == f:
                meetings.setdefault((f[0], len(words[f]), at), []).append(f)
        for members in meetings.values():
            if len(members) < 2 or all(f in group for f in members):
                continue
            leaders = []
            for f in sorted((f for f in members if (f, p) not in led), key=lambda f: (f not in group, -forms[f], f[1]))[:heads]:
                if f in group or not any(like(f, g) for g in leaders):
                    leaders.append(f)
            led |= {(g, p) for g in leaders}
            for f in members:
                fit = [g for g in leaders if like(f, g)]
                if f not in group and f not in leaders and fit:
                    joins[f] = max(fit, key=lambda g: (shared(f, g), -leaders.index(g)))
        group |= joins | {g: g for g in joins.values()}
        turn, quiet = turn + 1, 0 if joins else quiet + 1
    return group


def test_templates_keep_each_form_once(spark):
    """Long forms of several leaders, against a plain loop; on disk each form lies in one table when all have met."""
    import random

    from logquarry.sources import sinks

    r = random.Random(4)
    texts = []
    for t in range(6):
        base = [r.choice("abcdefgh") * 2 + r.choice("xyz") for _ in range((1, 2, 40, 62, 63, 131)[t])]
        texts += [" ".join(w if r.random() < 0.7 else r.choice("pqrs") * r.randint(1, 3) for w in base) for _ in range(25)]
    rows = [(s, i, x) for s in ("a", "b", None) for i, x in enumerate(texts)]
    before = len(sinks._scratch)
    got = {(x["source"], x["masked"]): (x["template"], x["size"], x["first_line"]) for x in parsing.templates(spark.createDataFrame(rows, "source string, line_no int, line string")).collect()}
    forms = {}
    for s, i, x in rows:
        n, first = forms.get((s, x), (0, i))
        forms[s, x] = n + 1, min(first, i)
    head = {}
    for place in (lambda w: w[:1], lambda w: w[-1:], lambda w: w[1:2], lambda w: w[len(w) // 2 : len(w) // 2 + 1]):
        meet = {}
        for s, x in forms:
            if s and (s, x) not in head:
                w = x.split(" ")
                meet.setdefault((s, len(w), *place(w)), []).append((forms[s, x][0], x))
        for key, members in meet.items():
            top = max(members)[1]
            like = [x for _, x in members if sum(a == b for a, b in zip(x.split(" "), top.split(" "))) >= 0.5 * key[1]]
            head |= {(key[0], x): top for x in like if len(like) > 1}
    want = {}
    for (s, x), (n, first) in forms.items():
        group = [y for (z, y), h in head.items() if z == s and h == head[s, x]] if (s, x) in head else []
        template = " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in zip(*(y.split(" ") for y in group)))
        want[s, x] = (template, sum(forms[s, y][0] for y in group), min(forms[s, y][1] for y in group)) if group else (x, n, first)
    assert got == want and len({h for h in head.values()}) > 5
    assert sum(spark.read.parquet(path).count() for _, path in sinks._scratch[before:] if path not in removed(spark, sinks._scratch[before:])) == len(forms)


def removed(spark, paths):
    """The paths that are not there any more."""
    there = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    return {path for _, path in paths if not there(path)}


def test_template_clusters_follow_every_leader(spark):
    import random

    # What one head a meeting leaves alone: words that differ at all places but two.
    r = random.Random(8)
    rows = [("s", i, f"accepted key {x}") for i, x in enumerate(["alice web one", "bob db two", "carol mail six"])] + [("s", 9, "closed door by hand again"), (None, 10, "fan alpha down"), (None, 11, "fan beta down"), ("s", 12, None), ("s", 13, "")]
    frame = lambda rows: spark.createDataFrame(rows, "source string, line_no int, line string")
    got = {(x["source"], x["template"]): x["size"] for x in parsing.template_clusters(frame(rows)).collect()}
    assert got == {("s", "accepted key <*> <*> <*>"): 3, ("s", "closed door by hand again"): 1, (None, "fan <*> down"): 2, ("s", None): 1, ("s", ""): 1}
    assert parsing.template_clusters(frame([])).count() == 0
    # Against loops, with so few heads that many turns are needed.
    lines = [(r.choice("st"), i, " ".join(r.choice(["a", "b", "c", "dd", "7", "x9"]) for _ in range(r.randint(2, 5)))) for i in range(260)]
    forms, found = {}, {}
    for x in parsing.template_clusters(frame(lines), 0.6, 2).collect():
        found[x["source"], x["masked"]] = (x["template"], x["size"])
    for source, _, line in lines:
        f = (source, line.replace("7", "<*>").replace("x9", "x<*>"))
        forms[f] = forms.get(f, 0) + 1
    group = clusters_brute(forms, 0.6, 2)
    of = {}
    for f in forms:
        of.setdefault((f[0], group.get(f, f)), []).append(f)
    want = {}
    for members in of.values():
        text = " ".join(w[0] if len(set(w)) == 1 else "<*>" for w in zip(*(f[1].split(" ") for f in members)))
        want |= {f: (text, sum(forms[m] for m in members)) for f in members}
    assert found == want and 20 < len(of) < len(forms)


def test_template_clusters_keep_each_form_once(spark):
    """On disk each form lies in one table when all have met; places beyond the first number of bits count."""
    from logquarry.sources import sinks

    rows = [("a", i, " ".join("vary" + "xyz"[i % 3] * (i % 5) if k in (3, 64, 129) else f"w{'k' * (k % 9)}" for k in range(130))) for i in range(15)] + [("b", 20, "one of its own"), (None, 21, None)]
    before = len(sinks._scratch)
    got = parsing.template_clusters(spark.createDataFrame(rows, "source string, line_no int, line string")).collect()
    assert {(x["source"], x["size"], tuple(i for i, w in enumerate((x["template"] or "").split(" ")) if w == "<*>")) for x in got} == {("a", 15, (3, 64, 129)), ("b", 1, ()), (None, 1, ())}
    tables = [path for _, path in sinks._scratch[before:]]
    assert sum(spark.read.parquet(path).count() for path in tables if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))[1:]) == len(got)


def test_template_clusters_find_planted_templates(spark):
    """Forty templates of one sender that begin alike, with words that never come again at up to half of their places."""
    import random

    r = random.Random(9)
    verbs, nouns = ["opened", "closed", "lost", "found", "sent"], ["session", "file", "route", "mail", "lease", "job", "disk", "key"]
    rows, planted = [], []
    for verb in verbs:
        for noun in nouns:
            planted.append(f"service {verb} {noun} <*> by <*> after {noun}{verb}")
            rows += [("s", len(rows) + i, planted[-1].replace("<*>", "{}").format(f"w{r.randrange(36**6):x}q", "u" + "".join(r.choice("ghijk") for _ in range(9)))) for i in range(25)]
    got = {x["template"]: x["size"] for x in parsing.template_clusters(spark.createDataFrame(rows, "source string, line_no int, line string"), 0.6, 8).collect()}
    assert sum(got.get(t) == 25 for t in planted) >= 0.95 * len(planted)


def test_entry_without_the_text_operations(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "logquarry", tmp_path / "logquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
