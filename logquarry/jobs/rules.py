"""Queries: rule predicates, selections, conditions and rule coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs.query import log_events, query
from logquarry.operators import rules as op

#: Events as documents: a line, an address, a port that every ninth lacks, two tags.
DOC_SQL = """doc as (
    select event_id, event_type as action, user_id, value, case when event_id % 9 = 0 then null else json_extract_string(props, '$.k') end as port,
        '10.' || (user_id % 4) || '.' || (event_id % 256) || '.' || (user_id % 200) as ip,
        'sshd: ' || event_type || ' for user' || user_id || ' from 10.' || (user_id % 4) || '.' || (event_id % 256) || '.' || (user_id % 200) as line
    from events
)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"), (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 200).cast("string"))
    ev = log_events(spark, d).withColumn("ip", ip)
    return ev.withColumn("line", F.concat(F.lit("sshd: "), "action", F.lit(" for user"), F.col("user_id").cast("string"), F.lit(" from "), "ip")).withColumn(
        "port", F.when(F.col("event_id") % 9 != 0, F.col("port"))
    )


_PATHS = {
    "event.action": lambda: F.array("action"), "source.ip": lambda: F.array("ip"), "source.port": lambda: F.array("port"), "event.original": lambda: F.array("line"),
    "client.ip": lambda: F.array(F.format_string("2001:db8:%x::%x", F.col("user_id") % 16, F.col("event_id") % 256)),
    "user.name": lambda: F.array(F.concat(F.lit("User"), F.col("user_id").cast("string"))), "tags": lambda: F.array(F.col("action"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string"))),
    "process.name": lambda: F.when(F.col("event_id") % 2 == 0, F.array(F.lit("sshd"))), "event.value": lambda: F.array(F.col("value").cast("string")),
    "destination.port": lambda: F.when(F.col("event_id") % 3 == 0, F.array("port")), "dns.question.name": lambda: F.when(F.col("event_id") % 5 == 0, F.array(F.concat("action", F.lit(".example.net")))),
    "http.request.method": lambda: F.when(F.col("event_id") % 7 == 0, F.array(F.lit("GET"))),
}


def values(path: str) -> Column:
    """The value array of a document path of these events; null where there is none."""
    make = _PATHS.get(path)
    return make() if make else F.lit(None).cast("array<string>")


def _matching(spark, d, test: Column) -> DataFrame:
    return docs(spark, d).where(test).select("event_id")


def _sql(where: str) -> str:
    return f"with {DOC_SQL} select event_id from doc where {where}"


def _field(name: str, where: str, key: str, wanted: object) -> None:
    def run(spark, d):
        return _matching(spark, d, op.field_test(values, key, wanted))

    run.__name__ = name
    query(_sql(where))(run)


_field("pred_eq_wild", "regexp_matches(lower('User' || user_id), '^user1.*[0-9]$') and lower('User' || user_id) like 'user1_'", "user.name", "uSER1?")
_field("pred_contains", "contains(lower(line), 'rror for') ", "event.original|contains", "RROR for")
_field("pred_startswith", "lower(line) like 'sshd: c%k for%'", "event.original|startswith", "SSHD: c*k for")
_field("pred_endswith", "line like '%.1' or line like '%.2'", "event.original|endswith", [".1", ".2"])
_field("pred_re", "regexp_matches(line, '(?i)USER1[0-9]+ from 10\\.[12]\\.')", "event.original|re|i", r"USER1[0-9]+ from 10\.[12]\.")
_field("pred_cidr", "user_id % 4 in (2, 3)", "source.ip|cidr", "10.2.0.0/15")
_field("pred_cidr6", "user_id % 16 < 4", "client.ip|cidr", "2001:db8::/46")
_field("pred_cmp", "try_cast(port as double) >= 70", "source.port|gte", 70)
_field("pred_exists", "port is null", "source.port|exists", False)
_field("pred_null", "port is null", "source.port", None)
_field("pred_number_bool", "port = '7'", "source.port", 7)


@query(_sql("(event_type_any) and user_id % 7 = 3").replace("event_type_any", "action in ('error', 'click')"))
def q_pred_list_any_all(spark, d):
    return _matching(spark, d, op.field_test(values, "event.action", ["error", "CLICK"]) & op.field_test(values, "tags|all", ["t3", "*"]))


@query(_sql("contains(line, 'error') and contains(line, '10.1.')"))
def q_pred_keywords(spark, d):
    return _matching(spark, d, op.keyword_test(values, ["ERROR", "10.1."], every=True))


@query(_sql("(action = 'error' and port = '5') or (action = 'view' and port is null)"))
def q_selection(spark, d):
    return _matching(spark, d, op.selection(values, [{"event.action": "error", "source.port": 5}, {"event.action": "view", "source.port": None}]))


@query(_sql("(action = 'error' or (action = 'click' and not coalesce(port = '5', false))) and not (user_id % 4 = 1)"))
def q_condition(spark, d):
    parts = {
        "sel_error": op.selection(values, {"event.action": "error"}),
        "Sel_click": op.selection(values, {"event.action": "click"}),
        "five": op.selection(values, {"source.port": "5"}),
        "_net": op.selection(values, {"source.ip|cidr": "10.1.0.0/16"}),
    }
    test = op.condition("1 of sel_* and (sel_error or Sel_click and not five) and NOT _net", parts)
    return _matching(spark, d, op.sure(test))


@query(f"""with {DOC_SQL} select event_id, event_id % 5 = 0 as dns, event_id % 3 = 0 and port is not null and event_id % 5 <> 0 and event_id % 7 <> 0 as firewall, event_id % 7 = 0 as webserver,
    event_id % 2 = 0 as sshd, event_id % 2 = 0 as auth, event_id % 7 = 0 as nginx, true as syslog, false as sudo, event_id % 2 = 0 as linux, true as own from doc""")
def q_logsource_filter(spark, d):
    kinds = {
        "dns": {"category": "dns"}, "firewall": {"category": "firewall"}, "webserver": {"category": "webserver", "product": "windows"}, "sshd": {"product": "linux", "service": "sshd"}, "auth": {"service": "auth"},
        "nginx": {"service": "nginx"}, "syslog": {"product": "linux", "service": "syslog"}, "sudo": {"service": "sudo"}, "linux": {"product": "linux"}, "own": {},
    }
    return docs(spark, d).select("event_id", *(op.logsource_test(values, k).alias(n) for n, k in kinds.items()))


RULES = [
    {"id": "failure", "title": "Failure", "level": "low", "detection": {"a": {"event.action": "error"}, "condition": "a"}},
    {"id": "purchase", "title": "Purchase", "level": "medium", "tags": ["attack.t1110", "attack.t1110.001", "attack.initial_access"], "detection": {"a": {"event.action|startswith": "pur"}, "condition": "a"}},
    {"id": "dns_error", "title": "Failed names", "level": "high", "logsource": {"category": "dns"}, "tags": ["attack.T1071"], "detection": {"a": {"query|startswith": "error"}, "b": {"query|endswith": ".com"}, "condition": "a and not b"}},
    {"id": "blocked_port", "title": "Low ports", "level": "low", "logsource": {"category": "firewall"}, "detection": {"a": {"dst_port|lt": 30}, "condition": "all of them"}},
    {"id": "ssh_words", "title": "Words", "level": "informational", "logsource": {"product": "linux", "service": "sshd"}, "detection": {"words": ["user12 ", "user13 "], "condition": "words"}},
    {"id": "bad_modifier", "title": "", "detection": {"a": {"event.action|base64": "x"}, "condition": "a"}},
    {"id": "bad_condition", "title": "", "detection": {"a": {"event.action": "x"}, "condition": "a and b"}},
    {"id": "bad_source", "title": "", "logsource": {"category": "process_creation"}, "detection": {"a": {"event.action": "x"}, "condition": "a"}},
    {"id": "burst", "title": "Many failures", "level": "high", "correlation": {"type": "event_count", "rules": ["failure"], "group-by": ["user_id"], "timespan": "6h", "condition": {"gte": 2}}},
    {"id": "temporal", "title": "", "correlation": {"type": "temporal", "rules": ["failure", "purchase"]}},
    {"id": "unmapped", "title": "", "logsource": {"category": "webserver"}, "detection": {"a": {"foo": None}, "condition": "a"}},
    {"id": "service_field", "title": "", "logsource": {"product": "linux", "service": "sshd"}, "detection": {"a": {"event.action": "x"}, "condition": "a"}},
    {"id": "other_product", "title": "", "logsource": {"product": "windows"}, "detection": {"a": {"event.action": "x"}, "condition": "a"}},
    {"id": "timeframe", "title": "", "detection": {"a": {"event.action": "x"}, "timeframe": "5m", "condition": "a"}},
    {"id": "two_conditions", "title": "", "detection": {"a": {"event.action": "x"}, "condition": ["a", "not a"]}},
    {"id": "bad_pattern", "title": "", "detection": {"a": {"event.action|re": "(?P<n>x)"}, "condition": "a"}},
    {"id": "bad_number", "title": "", "detection": {"a": {"event.value|gt": "abc"}, "condition": "a"}},
    {"id": "no_bases", "title": "", "correlation": {"type": "event_count", "rules": [], "condition": {"gte": 2}}},
    {"id": "no_field", "title": "", "correlation": {"type": "value_count", "rules": ["failure"], "condition": {"gte": 2}}},
    {"id": "two_ops", "title": "", "correlation": {"type": "event_count", "rules": ["failure"], "condition": {"gte": 2, "lt": 9}}},
]


def compiled() -> list[op.Rule]:
    return op.compile_rules(RULES, values)[0]


@query(f"with {DOC_SQL} select event_id, action || '.example.net' as name from doc where event_id % 5 = 0 and action = 'error'")
def q_field_taxonomy(spark, d):
    """A rule on a log kind's own field names reads the documents' paths."""
    rule = next(r for r in compiled() if r.id == "dns_error")
    return docs(spark, d).where(rule.test).select("event_id", F.concat("action", F.lit(".example.net")).alias("name"))


@query(f"""with {DOC_SQL}, r as (select * from (values ('bad_condition', false, 'no selection b'), ('bad_modifier', false, 'modifier base64'), ('bad_source', false, 'logsource process_creation'),
    ('blocked_port', true, ''), ('burst', true, ''), ('dns_error', true, ''), ('failure', true, ''), ('purchase', true, ''), ('ssh_words', true, ''), ('temporal', false, 'correlation temporal'),
    ('unmapped', false, 'field foo has no path'), ('service_field', false, 'field event.action has no path'), ('other_product', false, 'logsource windows'), ('timeframe', false, 'timeframe'), ('two_conditions', false, 'several conditions'),
    ('bad_pattern', false, 'bad pattern (?P<n>x)'), ('bad_number', false, 'no number abc'), ('no_bases', false, 'correlation without rules'), ('no_field', false, 'value_count needs a field'), ('two_ops', false, 'correlation needs one comparison')) as t(rule_id, supported, reason)),
    m as (select 'failure' as rule_id, count(*) as n from doc where action = 'error' union all select 'purchase', count(*) from doc where action = 'purchase'
        union all select 'dns_error', count(*) from doc where event_id % 5 = 0 and action = 'error' union all select 'blocked_port', count(*) from doc where event_id % 3 = 0 and event_id % 5 <> 0 and event_id % 7 <> 0 and try_cast(port as double) < 30
        union all select 'ssh_words', count(*) from doc where event_id % 2 = 0 and user_id in (12, 13))
    select rule_id, supported, reason, coalesce(n, 0) as n from r left join m using (rule_id)""")
def q_rule_coverage(spark, d):
    """Which rules run, why others do not, and how many events each matches."""
    from logquarry.operators.detection import match_rules

    known = spark.createDataFrame(op.coverage(RULES, values), "rule_id string, supported boolean, reason string")
    found = match_rules(docs(spark, d), compiled()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(found, "rule_id", "left").select("rule_id", "supported", "reason", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {DOC_SQL}, reads as (select * from (values ('failure', 'event.action'), ('purchase', 'event.action'), ('dns_error', 'dns.question.name'), ('blocked_port', 'destination.port'),
    ('ssh_words', 'event.original'), ('ssh_words', 'message')) as t(rule_id, path)),
    there as (select 'event.action' as path, count(*) as n from doc union all select 'dns.question.name', count(*) from doc where event_id % 5 = 0
        union all select 'destination.port', count(*) from doc where event_id % 3 = 0 and port is not null union all select 'event.original', count(*) from doc)
    select rule_id, path, coalesce(n, 0) as n from reads left join there using (path)""")
def q_used_fields(spark, d):
    """The paths that each rule reads, and in how many events they occur."""
    reads = [(r.id, p) for r in compiled() for p in r.fields]
    paths = sorted({p for _, p in reads})
    have = docs(spark, d).agg(*(F.count_if(op.present(values, p)).alias(p) for p in paths))
    counted = have.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"`{p}`").alias("n")) for p in paths))).alias("x")).select("x.*")
    return spark.createDataFrame(reads, "rule_id string, path string").join(counted, "path").select("rule_id", "path", "n")
