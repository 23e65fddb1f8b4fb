"""Queries: lines built from table columns and parsed back, and checks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.documents import leaves
from logquarry.jobs.query import LINES_SQL, log_events, micros, query, raw_lines, table
from logquarry.operators import parsing as op

SYSLOG = op.Spec(
    prefix=r"^(?P<ts>[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) (?P<host>\S+) (?P<prog>[\w-]+)\[(?P<pid>\d+)\]: (?P<rest>.*)$",
    body="rest",
    timestamp=("ts", "%b %d %H:%M:%S"),
    fields={"host.hostname": "host", "process.name": "prog", "process.pid": "pid"},
    constants={"event.kind": "event"},
    shapes=(
        op.Shape(r"^Failed (?P<how>\w+) for (?P<user>\S+) from (?P<ip>\S+) port (?P<port>\d+)", {"user.name": "user", "source.ip": "ip", "source.port": "port"}, {"event.outcome": "failure"}),
        op.Shape(r"^Accepted (?P<how>\w+) for (?P<user>\S+) from (?P<ip>\S+)", {"user.name": "user", "source.ip": "ip"}, {"event.outcome": "success"}),
    ),
)

LINE_SQL = """ln as (select event_id, 's' || (user_id % 10) as source, user_id, event_type as action, ts, case when user_id % 3 = 0 then 'nowhere' else '10.0.' || (user_id % 7) || '.' || (event_id % 250) end as ip,
    case when user_id % 11 = 0 then '-' else 'u' || user_id end as usr, json_extract_string(props, '$.k') as port from events)"""


def syslog_lines(spark: SparkSession, d: str) -> DataFrame:
    """event_id, source, line_no, line and what the line was made of: failed logins (errors), accepted ones
    (purchases, views) and lines of no shape."""
    ev = log_events(spark, d)
    text = lambda c: F.col(c).cast("string")
    ip = F.when(F.col("user_id") % 3 == 0, "nowhere").otherwise(F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string")))
    user = F.when(F.col("user_id") % 11 == 0, "-").otherwise(F.concat(F.lit("u"), text("user_id")))
    rest = (
        F.when(F.col("action") == "error", F.concat(F.lit("Failed password for "), user, F.lit(" from "), ip, F.lit(" port "), "port"))
        .when(F.col("action").isin("purchase", "view"), F.concat(F.lit("Accepted key for "), user, F.lit(" from "), ip))
        .otherwise(F.concat(F.lit("Closed session "), text("event_id")))
    )
    head = F.concat(F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "MMM dd HH:mm:ss"), F.lit(" "), "source", F.lit(" sshd["), text("event_id"), F.lit("]: "))
    return ev.select("event_id", "source", F.col("event_id").alias("line_no"), F.concat(head, rest).alias("line"), ip.alias("ip"), user.alias("usr"), "action", "port", "at")


def parsed(spark, d) -> DataFrame:
    doc, at = op.parse(SYSLOG, F.col("line"))
    return syslog_lines(spark, d).withColumn("doc", doc).withColumn("own", at)


@query(f"""with {LINE_SQL} select event_id, action in ('error', 'purchase', 'view') as ok, case when action in ('error', 'purchase', 'view') then source end as host, case when action in ('error', 'purchase', 'view') then event_id::varchar end as pid,
    case when action = 'error' then 'failure' when action in ('purchase', 'view') then 'success' end as outcome, case when action = 'error' then port end as port from ln""")
def q_parse_spec(spark, d):
    doc = F.col("doc")
    return parsed(spark, d).select("event_id", doc.isNotNull().alias("ok"), doc["host.hostname"].alias("host"), doc["process.pid"].alias("pid"), doc["event.outcome"].alias("outcome"), doc["source.port"].alias("port"))


@query("select event_id, (epoch_us(ts) // 1000000) * 1000000 as own_us, epoch_us(ts) // 1000000 * 1000000 as epoch_us from events")
def q_parse_prefix_ts(spark, d):
    """Times without a year, and epoch seconds."""
    seconds = F.floor(micros("at") / 1_000_000).cast("string")
    return parsed(spark, d).select("event_id", micros("own").alias("own_us"), micros(op.prefix_time(seconds, "%s", 2024)).alias("epoch_us"))


@query(f"with {LINE_SQL} select event_id, case when ip <> 'nowhere' then ip end as ip, case when usr <> '-' then usr end as usr from ln where action in ('error', 'purchase', 'view')")
def q_assign_guards(spark, d):
    return parsed(spark, d).where("doc is not null").select("event_id", F.col("doc")["source.ip"].alias("ip"), F.col("doc")["user.name"].alias("usr"))


def kv_lines(spark, d) -> DataFrame:
    """Parts as key-value lines in the four styles by turns (by size)."""
    p = table(spark, d, "part")
    pairs = [("id", F.col("p_partkey").cast("string")), ("name", F.col("p_name")), ("size", F.col("p_size").cast("string")), ("src", F.lit("10.1.2.3"))]
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    joined = lambda sep, eq, q: F.concat_ws(sep, *(F.concat(F.lit(k + eq), q(v)) for k, v in pairs))
    style = F.col("p_size") % 4
    line = F.when(style == 0, joined(" ", "=", quoted)).when(style == 1, joined("; ", ":", quoted)).when(style == 2, joined(", ", "=", quoted)).otherwise(joined("|", "=", lambda v: v))
    return p.select(F.col("p_partkey").alias("line_no"), style.alias("style"), F.concat(F.lit("k"), style.cast("string")).alias("source"), line.alias("line"), "p_name", "p_size")


@query("select p_partkey as line_no, p_name as name, p_size::varchar as size from part where p_size % 4 = 0")
def q_parse_kv(spark, d):
    doc, _ = op.parse(op.Spec(kv=op.KeyValues(0, {"name": "labels.name", "size": "labels.size", "none": "labels.none"})), F.col("line"))
    return kv_lines(spark, d).where("style = 0").select("line_no", doc["labels.name"].alias("name"), doc["labels.size"].alias("size"))


@query("select p_partkey as line_no, p_name as name, p_size::varchar as size from part")
def q_kv_styles(spark, d):
    maps = [op.kv_map(F.col("line"), i) for i in range(4)]
    pick = lambda key: F.coalesce(*(F.when(F.col("style") == i, m[key]) for i, m in enumerate(maps)))
    return kv_lines(spark, d).select("line_no", pick("name").alias("name"), pick("size").alias("size"))


@query("""with k as (select 'k' || (p_size % 4) as source, p_partkey, p_name, p_size from part), pairs as (select source, unnest(['id', 'name', 'size', 'src']) as key, p_partkey, p_name, p_size from k)
    select source, key, count(*) as n, case key when 'id' then min(p_partkey)::varchar when 'name' then arg_min(p_name, p_partkey) when 'size' then arg_min(p_size, p_partkey)::varchar else '10.1.2.3' end as example,
    case key when 'src' then 'source.ip' end as hint from pairs group by source, key""")
def q_detect_kv(spark, d):
    _, keys = op.detect_kv(kv_lines(spark, d))
    return op.key_hints(keys).select("source", "key", "n", "example", "hint")


@query("""select distinct 'k' || (p_size % 4) as source, case p_size % 4 when 2 then 0 else p_size % 4 end::int as style from part""")
def q_key_hints(spark, d):
    """The style of each sender's pairs, for senders whose keys include one that has a hint;
    the third style's pairs also read as the first's, which comes before it."""
    found, keys = op.detect_kv(kv_lines(spark, d))
    return found.join(op.key_hints(keys).where("hint is not null").select("source").distinct(), "source", "left_semi").select("source", "style")


def web_lines(spark, d) -> DataFrame:
    """Orders as web log lines: combined, common or with an extension, and broken ones for every 17th."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    clf = F.concat(F.lit("10.0.0."), (k % 250).cast("string"), F.lit(" - u"), (k % 50).cast("string"), F.lit(" [05/Jan/2024:10:00:00 +0000] \"GET /o/"), k.cast("string"), F.lit(" HTTP/1.1\" "), (F.lit(200) + k % 5).cast("string"), F.lit(" "), (k % 3000).cast("string"))
    cef = F.concat(F.lit("CEF:0|Acme|Wall|1|"), (k % 9).cast("string"), F.lit("|deny|5|src=10.0.0."), (k % 250).cast("string"), F.lit(" spt="), (k % 3000).cast("string"), F.lit(" proto=17 suser=u"), (k % 50).cast("string"))
    kind = F.col("o_custkey") % 3
    line = F.when(k % 17 == 0, "broken").when(kind == 0, F.concat(clf, F.lit(' "-" "agent/'), (k % 4).cast("string"), F.lit('"'))).when(kind == 1, clf).otherwise(cef)
    return o.select(k.alias("line_no"), F.concat(F.lit("w"), kind.cast("string")).alias("source"), line.alias("line"))


def _builtin(name: str, where: str, columns: dict[str, tuple[str, str]]) -> None:
    def run(spark, d):
        doc, _ = op.parse(op.BUILTIN[name], F.col("line"))
        rows = web_lines(spark, d).withColumn("doc", doc).where("doc is not null")
        return rows.select("line_no", *(F.col("doc")[p].alias(c) for c, (p, _) in columns.items()))

    run.__name__ = f"builtin_{name}"
    query(f"select o_orderkey as line_no, {', '.join(f'{s} as {c}' for c, (_, s) in columns.items())} from orders where o_orderkey % 17 <> 0 and {where}")(run)


_WEB = {
    "ip": ("source.ip", "'10.0.0.' || (o_orderkey % 250)"), "usr": ("user.name", "'u' || (o_orderkey % 50)"), "path": ("url.original", "'/o/' || o_orderkey"),
    "status": ("http.response.status_code", "(200 + o_orderkey % 5)::varchar"), "size": ("http.response.body.bytes", "(o_orderkey % 3000)::varchar"),
}
_builtin("combined", "o_custkey % 3 = 0", _WEB | {"agent": ("user_agent.original", "'agent/' || (o_orderkey % 4)"), "ref": ("http.request.referrer", "null::varchar")})
_builtin("common", "o_custkey % 3 in (0, 1)", _WEB)
_builtin("cef", "o_custkey % 3 = 2", {"ip": _WEB["ip"], "usr": _WEB["usr"], "port": ("source.port", "(o_orderkey % 3000)::varchar"), "proto": ("network.transport", "'udp'"), "code": ("event.code", "(o_orderkey % 9)::varchar"), "action": ("event.action", "'deny'")})


@query("""with f as (select *, row_number() over (partition by o_custkey % 3 order by o_orderkey) as n from orders)
    select 'w' || (o_custkey % 3) as source, case o_custkey % 3 when 0 then 'combined' when 1 then 'common' else 'cef' end as name, round(avg((o_orderkey % 17 <> 0)::int), 6) as rate from f where n <= 200 group by o_custkey % 3""")
def q_detect_builtin(spark, d):
    return op.detect_builtin(web_lines(spark, d)).select("source", "name", F.round("rate", 6).alias("rate"))


@query("""select distinct 's' || (user_id % 10) as source, 'syslog 3164 program' as name, 1.0::double as rate from events union all
    select 'w' || (o_custkey % 3), 'common log', round(avg((o_orderkey % 17 <> 0)::int), 6) from orders where o_custkey % 3 < 2 group by o_custkey % 3""")
def q_detect_header(spark, d):
    lines = syslog_lines(spark, d).select("source", "line").unionByName(web_lines(spark, d).select("source", "line"))
    return op.detect_header(lines).select("source", "name", F.round("rate", 6).alias("rate"))


@query(f"with {LINE_SQL} select source, count(*) as total, round(avg((action in ('error', 'purchase', 'view'))::int), 6) as rate from ln group by source")
def q_spec_coverage(spark, d):
    doc, _ = op.parse(SYSLOG, F.col("line"))
    return op.spec_coverage(syslog_lines(spark, d), doc).select("source", "total", F.round("rate", 6).alias("rate"))


@query(f"""with {LINE_SQL} select event_id, source, case when action not in ('error', 'purchase', 'view') then 'no shape fits' end as error from (select *, row_number() over (partition by source order by event_id desc) as n from ln) where n <= 20""")
def q_try_parser(spark, d):
    doc, _ = op.parse(SYSLOG, F.col("line"))
    return op.try_parser(syslog_lines(spark, d), doc).select("event_id", "source", "error")


@query(f"with {LINE_SQL} select source, round(avg((action in ('error', 'purchase', 'view'))::int), 6) as rate, min((action <> 'error')::int) = 1 as agree from ln group by source")
def q_real_lines_ok(spark, d):
    """A masking that writes ports as words breaks the failure shape, so agreement fails where there are failures."""
    rows = syslog_lines(spark, d).withColumn("mask", F.regexp_replace("line", r"port \d+", "port some"))
    raw, _ = op.parse(SYSLOG, F.col("line"))
    other, _ = op.parse(SYSLOG, F.col("mask"))
    return op.real_lines_ok(rows, raw, other).select("source", F.round("rate", 6).alias("rate"), "agree")


DOC_SQL = """d as (select event_id as id, user_id % 6 as k, user_id, event_type, 'error of u' || user_id || ' at 10:00:01' as raw from events)"""


def documents(spark, d) -> DataFrame:
    """doc_id, doc, raw: documents with one flaw or none by turns."""
    ev = log_events(spark, d)
    k, user = F.col("user_id") % 6, F.concat(F.lit("u"), F.col("user_id").cast("string"))
    when = lambda i, v: F.when(k == i, v)
    doc = F.to_json(F.struct(
        F.struct(F.when(k != 5, F.when(k == 1, "fine").otherwise("failure")).alias("outcome"), F.lit("line").alias("original")).alias("event"),
        F.struct(F.when(k != 5, user).alias("name"), when(2, "x").alias("username")).alias("user"),
        F.struct(when(3, "somewhere").alias("ip"), when(3, 70000).alias("port")).alias("source"),
        when(4, F.struct(F.lit("v").alias("code"))).alias("vendor"),
    ))
    raw = F.concat(F.lit("error of "), F.when(k == 0, "someone").otherwise(user), F.lit(" at 10:00:01"))
    return ev.select(F.col("event_id").alias("doc_id"), doc.alias("doc"), raw.alias("raw"))


@query(f"""with {DOC_SQL} select id as doc_id, 'user.name' as path, 'u' || user_id as value from d where k <> 5 union all select id, 'event.original', 'line' from d
    union all select id, 'event.outcome', case when k = 1 then 'fine' else 'failure' end from d where k <> 5 union all select id, 'user.username', 'x' from d where k = 2
    union all select id, 'source.ip', 'somewhere' from d where k = 3 union all select id, 'source.port', '70000' from d where k = 3 union all select id, 'vendor.code', 'v' from d where k = 4""")
def q_flatten_doc(spark, d):
    return leaves(documents(spark, d).drop("raw"), "doc").select("doc_id", "path", "value")


ERR_SQL = """errors as (select id as doc_id, 'event.outcome' as path, 'bad value' as problem, null as hint from d where k = 1 union all select id, 'user.username', 'unknown field', 'user.name' from d where k = 2
    union all select id, 'source.ip', 'no address', null from d where k = 3 union all select id, 'source.port', 'bad port', null from d where k = 3
    union all select id, 'vendor.code', 'unknown set', null from d where k = 4 union all select id, null, 'no fields', null from d where k = 5)"""


def _errors(spark, d) -> DataFrame:
    docs = documents(spark, d)
    return op.validate_docs(leaves(docs.drop("raw"), "doc"), docs)


@query(f"with {DOC_SQL}, {ERR_SQL} select * from errors")
def q_validate_ecs(spark, d):
    return _errors(spark, d)


LOOSE_SQL = """loose as (select id as doc_id, 'user.name' as path from d where k = 0 union all select id, 'user.username' from d where k = -1 union all select id, 'source.ip' from d where k = 3
    union all select id, 'source.port' from d where k = 3 union all select id, 'user.username' from d where k = 2 union all select id, 'vendor.code' from d where k = 4)"""


def _loose(spark, d) -> DataFrame:
    return op.ungrounded(leaves(documents(spark, d), "doc"))


@query(f"with {DOC_SQL}, {LOOSE_SQL} select doc_id, path from loose")
def q_ungrounded(spark, d):
    return _loose(spark, d).select("doc_id", "path")


@query(f"""with {DOC_SQL}, {ERR_SQL}, {LOOSE_SQL}, u as (select doc_id, count(*) as n from loose group by 1)
    select id as doc_id, case when user_id % 13 = 0 then 'runtime' when id in (select doc_id from errors) then 'schema' when n > 0 then 'ungrounded' else 'ok' end as outcome, coalesce(n, 0) as n_bad from d left join u on doc_id = id""")
def q_check_outcome(spark, d):
    docs = log_events(spark, d).select(F.col("event_id").alias("doc_id"), (F.col("user_id") % 13 != 0).alias("parsed"))
    return op.check_outcome(docs, _errors(spark, d), _loose(spark, d))


def doc_lines(spark, d) -> DataFrame:
    """All document lines with a number that is theirs alone."""
    return raw_lines(spark, d).withColumn("line_no", F.col("doc_id") * 100_000 + F.col("line_no"))


MASK_SQL = f"""{LINES_SQL}, m as (select source, doc_id * 100000 + line_no as line_no,
    regexp_replace(regexp_replace(regexp_replace(line, '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', '<*>', 'g'), '\\b0x[0-9a-fA-F]+\\b|\\b[0-9a-f]{{8,}}\\b', '<*>', 'g'), '\\d+', '<*>', 'g') as masked from lines)"""


def _meeting(after: str, name: str, word: str) -> str:
    """One step: forms left alone meet by a word."""
    return f"""{name} as (select source, masked, n, first_line, w, k, case when joins and count(*) filter (joins) over (partition by source, k, key, own) > 1 then md5(array_to_string(head, ' ')) else grp end as grp
        from (select *, grp is null and len(list_filter(list_zip(w, head), lambda x: x[1] = x[2])) >= 0.5 * k as joins
            from (select *, first_value(w) over (partition by source, k, key, own order by n desc, masked desc) as head
                from (select *, case when grp is null then w[{word}] end as key, case when grp is not null then masked end as own from {after}))))"""


TEMPLATE_SQL = f"""{MASK_SQL}, g0 as (select source, masked, count(*) as n, min(line_no) as first_line, string_split(masked, ' ') as w, len(string_split(masked, ' ')) as k, null::varchar as grp from m group by source, masked),
    {_meeting('g0', 'g1', '1')}, {_meeting('g1', 'g2', 'k')}, {_meeting('g2', 'g3', '2')}, {_meeting('g3', 'g4', 'k // 2 + 1')},
    words as (select source, grp, unnest(w) as v, generate_subscripts(w, 1) as i from g4 where grp is not null),
    places as (select source, grp, i, case when min(v) = max(v) then min(v) else '<*>' end as v from words group by all),
    texts as (select source, grp, string_agg(v, ' ' order by i) as template from places group by all),
    sizes as (select source, grp, sum(n)::bigint as size, min(first_line) as first_line from g4 where grp is not null group by all)"""


@query(f"""with {TEMPLATE_SQL} select g4.source, md5(masked) as form, md5(coalesce(template, masked)) as template, coalesce(size, n) as size, coalesce(sizes.first_line, g4.first_line) as first_line
    from g4 left join texts using (source, grp) left join sizes using (source, grp)""")
def q_templates(spark, d):
    return op.templates(doc_lines(spark, d)).select("source", F.md5("masked").alias("form"), F.md5("template").alias("template"), "size", F.col("first_line").cast("long").alias("first_line"))


@query()
def q_template_clusters(spark, d):
    """Templates with several leaders where forms meet: as they meet until nobody joins, a test holds it
    against a brute-force version."""
    return op.template_clusters(doc_lines(spark, d)).select("source", F.md5("masked").alias("form"), F.md5("template").alias("template"), "size", F.col("first_line").cast("long").alias("first_line"))


@query("""with l as (select event_id as line_no, event_type || user_id % 30 as template from events), s as (select template, count(*) as size, min(line_no) as first from l group by 1),
    r as (select l.*, row_number() over (partition by l.template order by line_no) as depth, size, first from l join s using (template)) select line_no, template from r order by depth, size desc, first limit 400""")
def q_stratified_sample(spark, d):
    rows = log_events(spark, d).select(F.col("event_id").alias("line_no"), F.concat("action", (F.col("user_id") % 30).cast("string")).alias("template"))
    return op.stratified_sample(rows, 400).select("line_no", "template")


@query(f"with {MASK_SQL}, t as (select masked, count(*) as n, count(*) filter (line_no % 3 = 0) as p from m group by 1) select sum(n)::bigint as lines, round(sum(p) / sum(n), 6) as line_rate, count(*) as templates, round(avg((p > 0)::int), 6) as template_rate from t")
def q_template_coverage(spark, d):
    rows = doc_lines(spark, d).withColumn("template", op.masked(F.col("line")))
    out = op.template_coverage(rows, F.col("line_no") % 3 == 0)
    return out.select("lines", F.round("line_rate", 6).alias("line_rate"), "templates", F.round("template_rate", 6).alias("template_rate"))
