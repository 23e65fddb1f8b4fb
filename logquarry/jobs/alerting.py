"""Queries: alerts from hits, their evidence and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs.detection import H, failures
from logquarry.jobs.query import EV_SQL, HOSTS_SQL, host_table, log_events, micros, query, table
from logquarry.operators import alerts as op
from logquarry.operators import detection
from logquarry.sources import sinks


def _dedup_sql(hits: str, minutes: int, count: str) -> str:
    return f"""{hits}, marked as (select *, case when us - {minutes * 60_000_000} > max(us) over (partition by source, user_id order by event_id rows between unbounded preceding and 1 preceding)
            or row_number() over (partition by source, user_id order by event_id) = 1 then 1 else 0 end as fresh from hits),
    islands as (select *, sum(fresh) over (partition by source, user_id order by event_id) as alert_no from marked),
    folded as (select source, user_id, alert_no::bigint as alert_no, min(us) as first_us, max(us) as last_us, {count} as n, min(event_id) as first_event from islands group by 1, 2, 3)"""


HITS_SQL = f"{EV_SQL}, hits as (select * from ev where action = 'error')"


def _hits(rows: DataFrame, n=None) -> DataFrame:
    return rows.select(
        F.lit("rule").alias("kind"), F.lit("failure").alias("rule_id"), "source", F.to_json(F.struct("user_id")).alias("group_key"), "user_id", "event_id", "at",
        (F.lit(None).cast("long") if n is None else n).alias("n"),
    )


def failure_alerts(spark: SparkSession, d: str, minutes: int = 1440) -> DataFrame:
    """Alerts of single failures: kind, rule_id, source, group_key, alert_no, first_seen, last_seen, count."""
    return op.dedup(_hits(failures(spark, d)).drop("user_id"), minutes)


def _flat(alerts: DataFrame) -> DataFrame:
    user = F.get_json_object("group_key", "$.user_id").cast("long").alias("user_id")
    return alerts.select("source", user, "alert_no", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), F.col("count").alias("n"), "first_event")


@query(f"with {_dedup_sql(HITS_SQL, 1440, 'count(*)')} select * from folded")
def q_alert_dedup(spark, d):
    return _flat(failure_alerts(spark, d))


FLAG_SQL = f"""{EV_SQL}, counted as (select event_id, source, user_id, us, count(*) over (partition by source, user_id order by ts range between interval 48 hour preceding and current row) as c from ev where action = 'error'),
    hits as (select * from counted where c >= 3)"""


@query(f"with {_dedup_sql(FLAG_SQL, 60, 'max(c)')} select * from folded")
def q_flagship_alerts(spark, d):
    """Users with three failures or more in two days, folded into alerts."""
    fired = detection.fired(detection.event_count(failures(spark, d), ["user_id"], 48 * H), "gte", 3)
    return _flat(op.dedup(_hits(fired, F.col("n")).drop("user_id"), 60))


ALERT_SQL = f"""{_dedup_sql(HITS_SQL, 1440, 'count(*)')}, alerts as (
    select first_event as alert_id, source, user_id, n, first_us, last_us, case first_event % 5 when 0 then 'informational' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end as level,
        case first_event % 4 when 0 then 'new' when 1 then 'acknowledged' when 2 then 'closed_fp' else 'closed_tp' end as status,
        case when first_event % 3 = 0 then 'new_sender' when first_event % 3 = 1 then 'host' else 'rule' end as kind, first_event % 7 = 0 as told from folded)"""


def alert_table(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of single failures with levels, states and kinds by turns; their id is their first event."""
    a, k = failure_alerts(spark, d), F.col("first_event")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return a.select(
        k.alias("alert_id"), "source", "group_key", F.col("count"), "first_seen", "last_seen", pick(["informational", "low", "medium", "high", "critical"]).alias("level"),
        pick(["new", "acknowledged", "closed_fp", "closed_tp"]).alias("status"), pick(["new_sender", "host", "rule"]).alias("kind"), (k % 7 == 0).cast("int").alias("notified"),
        F.concat(F.lit("Failures of "), "source").alias("title"),
    )


def alert_links(spark, d) -> DataFrame:
    """alert_id, event_id: the alerts' failures, found by their intervals."""
    a = alert_table(spark, d).select("alert_id", "source", F.get_json_object("group_key", "$.user_id").cast("long").alias("user_id"), "first_seen", "last_seen")
    inside = failures(spark, d).join(a, ["source", "user_id"]).where(F.col("at").between(F.col("first_seen"), F.col("last_seen")))
    return op.link_events(inside.groupBy("alert_id").agg(F.collect_list("event_id").alias("event_ids")), 3)


LINK_SQL = f"""{ALERT_SQL}, found as (select alert_id, event_id, h.us from hits h join alerts a on a.source = h.source and a.user_id = h.user_id and h.us between first_us and last_us),
    links as (select alert_id, event_id, us from (select *, row_number() over (partition by alert_id order by event_id) as n from found) where n <= 3)"""


@query(f"with {LINK_SQL} select alert_id, event_id from links")
def q_alert_events_link(spark, d):
    return alert_links(spark, d)


@query(f"with {LINK_SQL} select alert_id, event_id, us as at_us from (select *, row_number() over (partition by alert_id order by event_id desc) as n from links) where n <= 2")
def q_alert_events(spark, d):
    return op.events_of(alert_links(spark, d), log_events(spark, d), 2).select("alert_id", "event_id", micros("at").alias("at_us"))


@query(f"with {ALERT_SQL} select alert_id, source, status from alerts where status in ('new', 'acknowledged') and level = 'high' order by last_us desc, alert_id desc limit 200")
def q_alerts_list(spark, d):
    return op.listed(alert_table(spark, d), "open", "high").select("alert_id", "source", "status")


@query(f"""with {ALERT_SQL} select l.level, count(a.alert_id) as n from (values ('informational'), ('low'), ('medium'), ('high'), ('critical')) as l(level)
    left join (select * from alerts where status in ('new', 'acknowledged')) a on a.level = l.level group by 1 union all select 'total', count(*) from alerts where status in ('new', 'acknowledged')""")
def q_alert_counts(spark, d):
    return op.counts(alert_table(spark, d))


@query(f"""with {ALERT_SQL} select source, source in (select source from alerts where kind = 'host' and level = 'critical') as any_alert, source in (select source from alerts where kind = 'host' and level = 'critical' and status in ('new', 'acknowledged')) as open_alert from hosts
""".replace("with ev as", f"with {HOSTS_SQL}, ev as"))
def q_has_alert(spark, d):
    hosts, alerts = host_table(spark, d), alert_table(spark, d).where("kind = 'host' and level = 'critical'")
    flag = lambda only, name: op.has_alert(hosts, alerts, ["source"], only).select("source", F.lit(True).alias(name))
    out = hosts.select("source").join(flag(False, "any_alert"), "source", "left").join(flag(True, "open_alert"), "source", "left")
    return out.select("source", F.coalesce("any_alert", F.lit(False)).alias("any_alert"), F.coalesce("open_alert", F.lit(False)).alias("open_alert"))


@query(f"""with {ALERT_SQL} select source, 'low' as level, 'New sender ' || source as title from hosts where status = 'pending' and source not in (select source from alerts where kind = 'new_sender' and user_id % 10 = 1)
""".replace("with ev as", f"with {HOSTS_SQL}, ev as"))
def q_new_sender_alerts(spark, d):
    alerts = alert_table(spark, d).where("source = 's1'")
    return op.new_sender_alerts(host_table(spark, d), alerts).select("source", "level", "title")


@query(f"""with {ALERT_SQL} select source, 'high' as level, 'silent for 40 min; no parser' as title from hosts where status = 'approved' and source in ('s3', 's4', 's5')
    and source not in (select source from alerts where kind = 'host' and status in ('new', 'acknowledged') and source = 's4')""".replace("with ev as", f"with {HOSTS_SQL}, ev as"))
def q_host_critical_alerts(spark, d):
    hosts = host_table(spark, d)
    health = hosts.select("source", F.when(F.col("source").isin("s1", "s3", "s4", "s5"), "critical").otherwise("ok").alias("status"), F.array(F.lit("silent for 40 min"), F.lit("no parser")).alias("reasons"))
    return op.host_critical_alerts(health, hosts, alert_table(spark, d).where("source = 's4'")).select("source", "level", "title")


@query(f"""with {ALERT_SQL} select alert_id, case when kind = 'new_sender' and a.status in ('new', 'acknowledged') and h.status in ('approved', 'rejected') then 'resolved' else a.status end as status
    from alerts a left join hosts h using (source)""".replace("with ev as", f"with {HOSTS_SQL}, ev as"))
def q_alert_resolve(spark, d):
    return op.resolve(alert_table(spark, d), host_table(spark, d)).select("alert_id", "status")


@query(f"with {ALERT_SQL} select alert_id, case when alert_id % 6 = 0 then 'closed_tp' else status end as status, false as refused from alerts union all select alert_id, 'odd', true from alerts where alert_id % 6 = 3")
def q_alert_status(spark, d):
    alerts = alert_table(spark, d)
    decisions = alerts.where("alert_id % 6 in (0, 3)").select("alert_id", F.when(F.col("alert_id") % 6 == 0, "closed_tp").otherwise("odd").alias("status"))
    out, refused = op.set_status(alerts, decisions)
    return out.select("alert_id", "status", F.lit(False).alias("refused")).unionByName(refused.select("alert_id", "status", F.lit(True).alias("refused")))


@query("""with shipped as (select p_partkey as rule_id from part where p_partkey % 2 = 0), custom as (select * from part where p_partkey % 2 = 1 and p_size % 2 = 0)
    select rule_id, 'shipped' as origin from shipped where rule_id % 10 <> 4 and rule_id not in (select p_partkey + 1 from custom) union all select p_partkey, 'custom' from custom where p_partkey % 10 <> 4""")
def q_effective_rules(spark, d):
    p = table(spark, d, "part").withColumn("rule_id", F.col("p_partkey").cast("string"))
    shipped = p.where("p_partkey % 2 = 0").select("rule_id", F.lit("shipped").alias("origin"))
    custom = p.where("p_partkey % 2 = 1").select("rule_id", F.lit("custom").alias("origin"), F.when(F.col("p_size") % 2 == 0, "approved").otherwise("proposed").alias("status"),
        F.concat_ws(", ", F.lit("x"), (F.col("p_partkey") + 1).cast("string")).alias("replaces"))
    out = op.effective_rules(shipped, custom, p.where("p_partkey % 10 = 4").select("rule_id"))
    return out.select(F.col("rule_id").cast("long").alias("rule_id"), "origin")


@query(f"""with {ALERT_SQL} select alert_id, case when level in ('informational', 'low') then 2 else 1 end as notified,
    case when level not in ('informational', 'low') then '[' || upper(level) || '] Failures of ' || source || ' (' || n || ' x ' || kind || ')' || chr(10) || 'https://siem.example.org/alerts/' || alert_id end as body
    from alerts where not told""")
def q_alert_outbox(spark, d):
    return sinks.alert_outbox(alert_table(spark, d), "ntfy", "https://siem.example.org/", "medium")


TRIAGE_SQL = """with answers as (
    select conv_id * 1000 + turn as id, role, text, case when turn % 3 = 0 then 'true_positive' when turn % 3 = 1 then 'false_positive' else 'maybe' end as verdict,
        length(text) / 100.0 - 1 as confidence from conversations)
    select id, verdict <> 'maybe' as known, 1::bigint as bad_events, case when role = 'user' then 1 else 2 end::bigint as bad_attack, case when role = 'user' then 1 else 0 end::bigint as bad_entities, false as ok,
        round(greatest(0.0, least(1.0, confidence)), 6) as confidence from answers"""


@query(TRIAGE_SQL)
def q_triage_check(spark, d):
    """Stored conversations as answers that cite one wrong event and name addresses and techniques."""
    user = F.col("role") == "user"
    answers = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.element_at(F.array(F.lit("true_positive"), F.lit("false_positive"), F.lit("maybe")), (F.col("turn") % 3 + 1).cast("int")).alias("verdict"),
        F.lit("high").alias("severity"), (F.length("text") / 100.0 - 1).alias("confidence"), F.when(user, "seen 10.9.8.7 and user-0a1b2c").otherwise("seen user-0a1b2c").alias("summary"),
        F.array(F.lit(1), F.lit(2), F.lit(99)).cast("array<bigint>").alias("cited"), F.when(user, F.array(F.lit("T1110"), F.lit("T9"))).otherwise(F.array(F.lit("T1071"), F.lit("x"), F.lit("T1110"))).alias("attack"),
        F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("event_ids"), F.array(F.lit("T1110")).alias("rule_attack"), F.lit("login of user-0a1b2c").alias("evidence"),
    )
    out = op.triage_check(answers)
    sizes = [F.size(c).cast("long").alias(c) for c in ("bad_events", "bad_attack", "bad_entities")]
    return out.select("id", "known", *sizes, "ok", F.round("confidence", 6).alias("confidence"))


@query(f"""with {LINK_SQL}, e as (select alert_id, event_id, '[' || event_id || '] ' || substr('error of user ' || (select user_id from ev where ev.event_id = links.event_id), 1, 12) as line, row_number() over (partition by alert_id order by event_id) as n from links)
    select alert_id, string_agg(line, chr(10) order by event_id) as evidence from e where n <= 2 group by 1""")
def q_alert_evidence(spark, d):
    ev = log_events(spark, d).withColumn("text", F.concat(F.col("action"), F.lit(" of user "), F.col("user_id").cast("string")))
    return op.evidence_texts(alert_links(spark, d), ev, "text", 2, 12)
