"""Queries: scores against labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.jobs.query import log_events, query, table
from logquarry.operators import scoring as op


def _fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(predicted, expected) fields of orders: status, priority and amount, some wrong, some missing."""
    o = table(spark, d, "orders")
    one = lambda c: F.array(c.cast("string"))
    k = F.col("o_orderkey")
    expected = [("event.outcome", one(F.col("o_orderstatus")), F.lit(True)), ("event.action", one(F.col("o_orderpriority")), k % 7 != 0), ("process.pid", one(F.col("o_custkey")), F.lit(True))]
    predicted = [("event.outcome", one(F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))), k % 3 != 0), ("event.action", F.array(F.lit("other"), F.col("o_orderpriority")), F.lit(True)), ("process.pid", one(F.col("o_custkey")), k % 4 == 0)]

    def of(fields):
        rows = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("values"), w.alias("there")) for n, v, w in fields)))
        return o.select(k.alias("doc_id"), rows.alias("x")).where("x.there").select("doc_id", "x.field", "x.values")

    return of(predicted), of(expected)


@query("""with c as (select sum(case when o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 then 1 else 0 end + case when o_orderkey % 7 <> 0 then 1 else 0 end + case when o_orderkey % 4 = 0 then 1 else 0 end)::bigint as tp,
        sum(case when o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 then 1 else 0 end + case when o_orderkey % 7 = 0 then 1 else 0 end)::bigint as fp,
        sum(case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 1 else 0 end + case when o_orderkey % 4 <> 0 then 1 else 0 end)::bigint as fn from orders)
    select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
def q_field_f1(spark, d):
    r = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return op.field_f1(*_fields(spark, d)).select("tp", "fp", "fn", *r)


HALF_SQL = """halves as (select l_orderkey as fixture, l_linenumber as line_no, l_returnflag <> 'R' as parsed, row_number() over (partition by l_orderkey order by l_linenumber) <= greatest(1, count(*) over (partition by l_orderkey) // 2) as visible from lineitem)"""


def halves(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fixture"), F.col("l_linenumber").alias("line_no"), (F.col("l_returnflag") != "R").alias("parsed"))
    return op.split_halves(rows)


# line numbers can repeat inside an order of the test table, so only counts are compared
@query(f"with {HALF_SQL} select fixture, count(*) filter (visible) as n_visible, count(*) filter (not visible) as n_hidden from halves group by 1")
def q_split_halves(spark, d):
    return halves(spark, d).groupBy("fixture").agg(F.count_if("visible").alias("n_visible"), F.count_if(~F.col("visible")).alias("n_hidden"))


@query("""with halves as (select 'u' || user_id as fixture, event_id, event_type <> 'error' as parsed, row_number() over (partition by user_id order by event_id) <= greatest(1, count(*) over (partition by user_id) // 2) as visible from events)
    select fixture, round(avg(parsed::int), 6) as rate from halves where not visible group by 1""")
def q_heldout_parsed(spark, d):
    rows = log_events(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fixture"), F.col("event_id").alias("line_no"), (F.col("action") != "error").alias("parsed"))
    return op.heldout_parsed(op.split_halves(rows)).select("fixture", F.round("rate", 6).alias("rate"))


def _values(spark, d) -> DataFrame:
    """Lines naming a user and an address; pseudonymised ones keep the user for every fourth, the address
    never, and replace the user's number alone for every sixth."""
    ev = log_events(spark, d)
    user, ip = F.concat(F.lit("u."), F.col("user_id").cast("string")), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    raw = F.concat(F.lit("login of "), user, F.lit(" from "), ip)
    out = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("login of "), user, F.lit(" from 10.1.1.1"))).otherwise(F.concat(F.lit("login of user-00ff00x"), user, F.lit(" from 10.1.1.1")))
    field = F.explode(F.array(F.struct(F.lit("user.name").alias("field"), user.alias("value")), F.struct(F.lit("source.ip").alias("field"), ip.alias("value")), F.struct(F.lit("url.path").alias("field"), F.lit("/login").alias("value")), F.struct(F.lit("host.hostname").alias("field"), F.lit("absent").alias("value"))))
    return ev.select("event_id", "source", raw.alias("raw"), out.alias("outgoing"), field.alias("f")).select("event_id", "source", "f.*", "raw", "outgoing")


@query("""with n as (select count(*) as total, count(*) filter (event_id % 4 = 0) as kept, count(*) filter (user_id % 250 = -1) as zero from events)
    select 'user.name' as field, kept as leaked, total, round(kept / total, 6) as rate from n union all select 'source.ip', zero, total, 0.0 from n union all select null, kept, 2 * total, round(kept / (2 * total), 6) from n""")
def q_leak_rate(spark, d):
    return op.leak_rate(_values(spark, d)).select("field", "leaked", "total", F.round("rate", 6).alias("rate"))


@query("""select 's' || (user_id % 10) as fixture, count(*) as leaked_before, count(*) filter (event_id % 4 = 0) as leaked_after, 2 * count(*) as total, count(distinct user_id) as caught_sensitive, 1::bigint as caught_other from events group by 1""")
def q_learn_effect(spark, d):
    v = _values(spark, d).withColumnRenamed("source", "fixture")
    before = F.when(F.col("field") == "user.name", F.col("raw")).otherwise(F.col("outgoing"))
    values = v.withColumn("before", before).withColumnRenamed("outgoing", "after")
    caught = v.where("field = 'user.name'").select("fixture", "value").unionByName(v.select("fixture", F.lit("process").alias("value")))
    return op.learn_effect(values, caught)


RUN_SQL = """runs as (select p_brand as model, p_type as mode, p_size % 10 as fixture, p_size % 3 = 0 as passed, case when p_size % 4 <> 0 then p_retailprice / 3000 end as f1, (p_partkey % 11) / 10 as parsed,
    p_partkey % 5 as attempts, p_partkey % 7 as latency, p_partkey % 2 as ungrounded from part)"""


@query(f"""with {RUN_SQL}, k as (select model, avg(anyp) as passk, count(*) as fixtures from (select model, fixture, max(passed::int) as anyp from runs group by 1, 2) group by 1)
    select model, count(*) as runs, round(avg(passed::int), 6) as pass1, round(avg(coalesce(f1, 0)), 6) as f1, round(avg(f1), 6) as f1_proposed, round(avg(parsed), 6) as parsed, round(avg(attempts), 6) as attempts,
    round(avg(latency), 6) as latency, sum(ungrounded)::bigint as ungrounded, round(any_value(passk), 6) as passk, any_value(fixtures) as fixtures from runs join k using (model) group by model""")
def q_eval_report(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    runs = table(spark, d, "part").select(
        F.col("p_brand").alias("model"), (s % 10).alias("fixture"), (s % 3 == 0).alias("passed"), F.when(s % 4 != 0, F.col("p_retailprice") / 3000).alias("f1"), ((k % 11) / 10).alias("parsed"),
        (k % 5).alias("attempts"), (k % 7).alias("latency"), (k % 2).alias("ungrounded"),
    )
    out = op.eval_report(runs, ["model"])
    r = [F.round(c, 6).alias(c) for c in ("pass1", "f1", "f1_proposed", "parsed", "attempts", "latency", "passk")]
    return out.select("model", "runs", "ungrounded", "fixtures", *r)


@query("""with grid as (select distinct n_name as case_, r_name as model, run from nation, region, (select unnest([1, 2, 3]) as run))
    select case_ as "case", model, run from grid where not exists (select 1 from nation n join region r on r.r_regionkey = n.n_regionkey where n_name = case_ and r_name = model and run < 3)""")
def q_pending_runs(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    done = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("case"), F.col("r_name").alias("model"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    return op.pending_runs(n.select(F.col("n_name").alias("case")), r.select(F.col("r_name").alias("model")), 3, done)


CASES = [(1, ["error"], None), (2, ["purchase", "view"], None), (3, None, ["3", "5", "8"])]
WANT_SQL = """wanted as (select 1 as n, event_id::varchar as id from events where event_type = 'error' union all select 2, event_id::varchar from events where event_type in ('purchase', 'view') union all select 3, unnest(['3', '5', '8']))"""


def _wanted(spark, d) -> DataFrame:
    ev = log_events(spark, d).select("event_id", F.array("action", F.lit("all")).alias("labels"))
    return op.hunt_expected(ev, spark.createDataFrame(CASES, "n int, labels array<string>, groups array<string>"))


@query(f"with {WANT_SQL} select n, id from wanted")
def q_hunt_expected(spark, d):
    return _wanted(spark, d)


SCORE_SQL = f"""{WANT_SQL}, answered as (select 1 as n, event_id::varchar as id from events where event_type = 'error' union all select 2, event_id::varchar from events where event_type in ('view', 'click') union all select 3, unnest(['3', '9'])),
    both_ as (select coalesce(w.n, a.n) as n, w.id is not null as e, a.id is not null as a from wanted w full join answered a on a.n = w.n and a.id = w.id),
    scores as (select n, count(*) filter (e) as expected, count(*) filter (a) as returned, count(*) filter (e and a) as h from both_ group by 1)"""


def scores(spark, d) -> DataFrame:
    ev = log_events(spark, d)
    answered = ev.where("action = 'error'").select(F.lit(1).alias("n"), F.col("event_id").cast("string").alias("id")).unionByName(
        ev.where("action in ('view', 'click')").select(F.lit(2).alias("n"), F.col("event_id").cast("string").alias("id"))
    )
    return op.hunt_score(_wanted(spark, d), answered.unionByName(spark.createDataFrame([(3, "3"), (3, "9")], "n int, id string")))


@query(f"with {SCORE_SQL} select n, expected, returned, round(h / returned, 6) as precision, round(h / expected, 6) as recall, h = expected and h = returned as exact from scores")
def q_hunt_score(spark, d):
    return scores(spark, d).select("n", "expected", "returned", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "exact")


@query(f"""with {SCORE_SQL} select case when n < 3 then 'dev' else 'holdout' end as "set", count(*) as cases, avg((n <> 2)::int)::double as valid, round(avg((h = expected and h = returned)::int), 6) as exact, round(avg(h / returned), 6) as precision, round(avg(h / expected), 6) as recall, avg(n)::double as attempts from scores group by 1""")
def q_hunt_summary(spark, d):
    rows = scores(spark, d).select("*", F.when(F.col("n") < 3, "dev").otherwise("holdout").alias("set"), (F.col("n") != 2).alias("valid"), F.col("n").alias("attempts"))
    out = op.hunt_summary(rows)
    return out.select("set", "cases", "valid", F.round("exact", 6).alias("exact"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "attempts")
