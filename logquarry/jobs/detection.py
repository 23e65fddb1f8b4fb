"""Queries: rule matches, correlations and back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs import rules as rq
from logquarry.jobs.query import EV_SQL, log_events, micros, query
from logquarry.operators import detection as op
from logquarry.operators import rules as rules_op

H = 3600

MATCH_SQL = f"""{rq.DOC_SQL}, matches as (
    select 'failure' as rule_id, event_id from doc where action = 'error' union all select 'purchase', event_id from doc where action = 'purchase'
    union all select 'dns_error', event_id from doc where event_id % 5 = 0 and action = 'error'
    union all select 'blocked_port', event_id from doc where event_id % 3 = 0 and event_id % 5 <> 0 and event_id % 7 <> 0 and try_cast(port as double) < 30
    union all select 'ssh_words', event_id from doc where event_id % 2 = 0 and user_id in (12, 13)
)"""


@query(f"with {MATCH_SQL} select rule_id, event_id from matches")
def q_match_rules(spark, d):
    return op.match_rules(rq.docs(spark, d), rq.compiled()).select("rule_id", "event_id")


@query(f"with {MATCH_SQL} select rule_id, event_id from matches where rule_id <> 'failure'")
def q_silent_bases(spark, d):
    rules = rq.compiled()
    return op.silent(op.match_rules(rq.docs(spark, d), rules), rules).select("rule_id", "event_id")


#: Rules of the kinds that such a tool ships, over synthetic service lines made from orders.
BASES = {
    "ssh_failure": {"id": "ssh_failure", "detection": {"process": {"process.name|contains": "sshd"}, "failure": {"event.original|contains": ["failed password", "invalid user"]}, "condition": "process and failure"}},
    "fw_block": {"id": "fw_block", "logsource": {"category": "firewall"}, "detection": {"a": {"action": ["block", "deny", "drop"]}, "f": {"dst_port": None}, "condition": "a and not f"}},
    "http_404": {"id": "http_404", "logsource": {"category": "webserver"}, "detection": {"a": {"sc-status": 404}, "condition": "a"}},
    "dns_long_label": {"id": "dns_long_label", "logsource": {"category": "dns"}, "detection": {"a": {"query|re": r"(^|\.)[^.]{40,}\."}, "condition": "a"}},
}


def service_docs(spark: SparkSession, d: str) -> DataFrame:
    """Events as service logs: logins, blocked connections, page views and look-ups by turns."""
    ev = log_events(spark, d)
    kind = F.col("event_id") % 4
    return ev.select(
        "event_id", "source", "user_id", "at", kind.alias("kind"), "port", "action",
        F.when(kind == 0, F.concat(F.when(F.col("action") == "error", "Failed password").otherwise("Accepted key"), F.lit(" for u"), F.col("user_id").cast("string"))).alias("line"),
        F.when(kind == 1, F.when(F.col("action").isin("error", "view"), "deny").otherwise("allow")).alias("verdict"),
        F.when(kind == 2, F.when(F.col("action") == "click", "404").otherwise("200")).alias("status"),
        F.when(kind == 3, F.concat(F.repeat(F.lit("a"), F.col("user_id").cast("int") % 60), F.lit(".example.net"))).alias("name"),
    )


SERVICE_SQL = """svc as (
    select event_id, 's' || (user_id % 10) as source, user_id, epoch_us(ts) as us, ts, event_id % 4 as kind, json_extract_string(props, '$.k') as port, event_type as action from events
), base as (
    select *, kind = 0 and action = 'error' as ssh_failure, kind = 1 and action in ('error', 'view') as fw_block, kind = 2 and action = 'click' as http_404,
        kind = 3 and user_id % 60 >= 40 as dns_long_label from svc
)"""

_SERVICE_PATHS = {
    "event.original": lambda: F.array("line"), "process.name": lambda: F.when(F.col("kind") == 0, F.array(F.lit("sshd"))), "event.action": lambda: F.array("verdict"),
    "destination.port": lambda: F.when(F.col("kind") == 1, F.array("port")), "http.response.status_code": lambda: F.array("status"),
    "url.path": lambda: F.when(F.col("kind") == 2, F.array(F.lit("/"))), "dns.question.name": lambda: F.array("name"),
}


def service_values(path: str):
    make = _SERVICE_PATHS.get(path)
    return make() if make else F.lit(None).cast("array<string>")


def base_matches(spark, d, name: str) -> DataFrame:
    rule = rules_op.compile_rule(BASES[name], service_values)
    return op.match_rules(service_docs(spark, d), [rule], ("event_id", "source", "user_id", "at", "port")).drop("rule_id")


def _base(name: str) -> None:
    def run(spark, d):
        return base_matches(spark, d, name).select("event_id", "source")

    run.__name__ = f"rule_{name}"
    query(f"with {SERVICE_SQL} select event_id, source from base where {name}")(run)


for _name in BASES:
    _base(_name)


def failures(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).where("action = 'error'")


def _count_sql(filter_: str, hours: int, what: str = "count(*)") -> str:
    return f"""{EV_SQL}, counted as (select event_id, source, user_id, us, {what} over (partition by source, user_id order by ts range between interval {hours} hour preceding and current row) as n
        from ev where {filter_})"""


@query(f"with {_count_sql("action = 'error'", 12)} select event_id, source, user_id, n from counted where n >= 2")
def q_corr_event_count(spark, d):
    return op.fired(op.event_count(failures(spark, d), ["user_id"], 12 * H), "gte", 2).select("event_id", "source", "user_id", "n")


@query(f"""with {EV_SQL}, counted as (select event_id, source, user_id, count(distinct coalesce(case when event_id % 9 <> 0 then port end, 'none'))
        over (partition by source, user_id order by ts range between interval 48 hour preceding and current row) as n from ev where action <> 'view')
    select event_id, source, user_id, n from counted where n >= 3""")
def q_corr_value_count(spark, d):
    rows = log_events(spark, d).where("action <> 'view'").withColumn("port", F.when(F.col("event_id") % 9 != 0, F.col("port")))
    return op.fired(op.value_count(rows, ["user_id"], "port", 48 * H), "gte", 3).select("event_id", "source", "user_id", "n")


@query(f"""with {EV_SQL}, m as (select * from ev where action = 'error')
    select e.event_id, e.source, e.user_id, count(*) as n from m e join m p on p.source = e.source and p.user_id = e.user_id and p.event_id <= e.event_id and p.us between e.us - 86400000000 and e.us
    group by all having count(*) >= 2""")
def q_corr_live_arrival(spark, d):
    return op.fired(op.live_count(failures(spark, d), ["user_id"], 24 * H), "gte", 2).select("event_id", "source", "user_id", "n")


@query(f"with {EV_SQL} select source, count(*) as n, count(*) filter (event_id % 9 <> 0) as n_grouped from ev where action = 'error' group by source")
def q_corr_null_group(spark, d):
    rows = failures(spark, d).withColumn("port", F.when(F.col("event_id") % 9 != 0, F.col("port")))
    kept = op.with_groups(rows, ["port"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_grouped"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(kept, "source", "left")


def _shipped(name: str, base: str, hours: int, limit: int, field: str | None) -> None:
    def run(spark, d):
        found = base_matches(spark, d, base)
        counted = op.value_count(found, ["user_id"], field, hours * H) if field else op.event_count(found, ["user_id"], hours * H)
        return op.fired(counted, "gte", limit).select("event_id", "source", "user_id", "n")

    what = f"count(distinct {field})" if field else "count(*)"
    run.__name__ = name
    query(f"""with {SERVICE_SQL}, counted as (select event_id, source, user_id, {what} over (partition by source, user_id order by ts range between interval {hours} hour preceding and current row) as n
        from base where {base}) select event_id, source, user_id, n from counted where n >= {limit}""")(run)


_shipped("rule_ssh_bruteforce", "ssh_failure", 72, 2, None)
_shipped("rule_port_scan", "fw_block", 48, 2, "port")
_shipped("rule_web_scan", "http_404", 72, 2, None)


@query(f"""with {MATCH_SQL}, latest as (select * from doc order by event_id desc limit 20000),
    r as (select * from (values ('failure', 'base'), ('purchase', 'rule'), ('dns_error', 'rule'), ('blocked_port', 'rule'), ('ssh_words', 'rule')) as t(rule_id, kind))
    select rule_id, kind, count(l.event_id) as n, coalesce(string_agg(l.event_id::varchar, ',' order by l.event_id), '') as event_ids
    from r left join (select m.* from matches m join latest using (event_id)) l using (rule_id) group by 1, 2""")
def q_backtest(spark, d):
    out = op.backtest(rq.docs(spark, d), rq.compiled())
    return out.select("rule_id", "kind", "n", F.concat_ws(",", F.col("event_ids").cast("array<string>")).alias("event_ids"))


BEST_SQL = f"""{_count_sql("action = 'error'", 48)}, best as (select source, user_id, n, us, row_number() over (partition by source, user_id order by n desc, us) as r from counted),
    groups as (select source, user_id, n, us from best where r = 1 and n >= 3),
    filled as (select g.source, g.user_id, g.n, g.us, list(c.event_id order by c.event_id) as ids from groups g join counted c on c.source = g.source and c.user_id = g.user_id and c.us between g.us - 172800000000 and g.us group by all)"""


def best_groups(spark, d) -> DataFrame:
    return op.best_windows(op.event_count(failures(spark, d), ["user_id"], 48 * H), ["user_id"], 48 * H, "gte", 3)


@query(f"with {BEST_SQL} select source, user_id, n, us as at_us, array_to_string(ids, ',') as event_ids from filled")
def q_backtest_correlation(spark, d):
    out = best_groups(spark, d)
    return out.select("source", "user_id", "n", micros("at").alias("at_us"), F.concat_ws(",", F.col("event_ids").cast("array<string>")).alias("event_ids"))


@query(f"""with {BEST_SQL}, placed as (select *, row_number() over (order by n desc, source, user_id::varchar) as place from filled)
    select source, user_id, n, place, array_to_string(ids[1:2], ',') as event_ids from placed where place <= 20""")
def q_backtest_summary(spark, d):
    groups = best_groups(spark, d).withColumn("rule_id", F.lit("burst")).withColumn("group_key", F.col("user_id").cast("string"))
    tested = op.backtest(rq.docs(spark, d), rq.compiled())
    _, kept = op.backtest_summary(tested, groups, each=2)
    return kept.select("source", "user_id", "n", F.col("place").cast("long").alias("place"), F.concat_ws(",", F.col("event_ids").cast("array<string>")).alias("event_ids"))


@query(f"""with {EV_SQL}, alerts as (select doc_id as alert_id, case when toxic = 1 then 'closed_tp' else 'closed_fp' end as status from labels),
    links as (select user_id as alert_id, event_id, ts, action from ev where user_id in (select alert_id from alerts)),
    hits as (select distinct alert_id from (select alert_id, count(*) over (partition by alert_id order by ts range between interval 24 hour preceding and current row) as n from links where action = 'error') where n >= 3),
    f as (select a.*, h.alert_id is not null as hit from alerts a left join hits h using (alert_id) where a.alert_id in (select alert_id from links))
    select count(*) filter (status = 'closed_fp') as fp, count(*) filter (status = 'closed_fp' and not hit) as fp_removed, count(*) filter (status = 'closed_tp') as tp,
        count(*) filter (status = 'closed_tp' and hit) as tp_kept, coalesce(string_agg(alert_id::varchar, ',' order by alert_id) filter (status = 'closed_tp' and not hit), '') as tp_lost from f""")
def q_fp_effect(spark, d):
    """Alerts judged by labels, with each user's events as evidence; the candidate wants three failures a day."""
    from logquarry.jobs.query import table

    alerts = table(spark, d, "labels").select(F.col("doc_id").alias("alert_id"), F.when(F.col("toxic") == 1, "closed_tp").otherwise("closed_fp").alias("status"))
    links = log_events(spark, d).select(F.col("user_id").alias("alert_id"), "event_id", "at", "action").join(alerts.select("alert_id"), "alert_id", "left_semi")
    counted = op.event_count(links.where("action = 'error'"), [], 24 * H, key=("alert_id",))
    out = op.fp_effect(alerts, links, op.fired(counted, "gte", 3).select("alert_id"))
    return out.withColumn("tp_lost", F.concat_ws(",", F.col("tp_lost").cast("array<string>")))


@query("""with leaves as (select event_id as doc_id, 'event.action' as path, event_type as value from events union all select event_id, 'source.port', json_extract_string(props, '$.k') from events
        union all select event_id, 'event.original', 'line ' || event_id from events where event_id % 3 = 0),
    n as (select path, count(distinct doc_id) as n from leaves group by 1), few as (select path, value, row_number() over (partition by path order by value) as k from (select distinct path, value from leaves where path <> 'event.original' and value is not null))
    select path, n, coalesce((select string_agg(value, ',' order by value) from few f where f.path = n.path and k <= 4), '') as examples from n""")
def q_field_catalogue(spark, d):
    ev = log_events(spark, d)
    doc = F.to_json(F.struct(F.struct(F.col("action").alias("action"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("line "), F.col("event_id").cast("string"))).alias("original")).alias("event"), F.struct("port").alias("source")))
    from logquarry.functions.documents import leaves

    return op.field_catalogue(leaves(ev.select(F.col("event_id").alias("doc_id"), doc.alias("doc")), "doc")).select("path", "n", F.coalesce(F.concat_ws(",", "examples"), F.lit("")).alias("examples"))


@query("select p_partkey as rule_id, case p_size % 3 when 0 then 'T1110,T1110.001' when 1 then 'T1071' else '' end as techniques from part")
def q_attack_tags(spark, d):
    from logquarry.jobs.query import table

    k = F.col("p_size") % 3
    tags = F.when(k == 0, F.array(F.lit("attack.t1110.001"), F.lit("attack.T1110"), F.lit("attack.t1110"))).when(k == 1, F.array(F.lit("attack.t1071"), F.lit("attack.execution"))).otherwise(F.array(F.lit("t1234")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.concat_ws(",", rules_op.technique_ids(tags)).alias("techniques"))
