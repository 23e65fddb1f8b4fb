"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.embedding_dedup import near_embeddings
from logquarry.llm.filter_audit import audit_filters
from logquarry.llm.license_scan import scan_licenses
from logquarry.llm.middle import fill_in_middle, restored
from logquarry.llm.near_dedup import near_duplicates
from logquarry.llm.packing import pack
from logquarry.llm.piece_lattice import segment
from logquarry.llm.quality import quality
from logquarry.llm.repeats import remove_repeats
from logquarry.llm.secret_scan import labelled_findings, places, scan_secrets, train
from logquarry.llm.tables import save, table
from logquarry.llm.token_files import token_file_round_trip
from logquarry.llm.tokens import vocabulary
from logquarry.llm.toxicity import severity, train_on_labels
from logquarry.llm.url_filter import judge_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on_labels(docs, table(spark, sf_dir, "labels"))
    return severity(docs, model).withColumn("p_above", F.concat_ws(",", F.transform("p_above", lambda p: F.format_string("%.6f", p))))


def op2_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), n=4)
    return found.withColumn("scores", F.concat_ws(",", F.col("scores").cast("array<string>"))).withColumn(
        "path_crc32", F.concat_ws(",", F.col("path_crc32").cast("array<string>"))
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400).withColumnRenamed("kept_text", "text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train(save(labelled_findings(docs))))
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda f: f["kind"] != "learned")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(places(base), 256).alias("base_sha256"), places(F.col("findings")).alias("spans"), of("learned"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_piece_lattice, op3_best_fit_packing, op4_url_filter, op5_license_scan, op6_near_embeddings, op7_near_duplicates, op8_token_files, op9_quality_rules, op10_repeated_strings, op11_fill_in_middle, op12_filter_audit, op13_secret_scan)
}

SQL: dict[str, str] = {
    "op6_near_embeddings": """
with recursive sound as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as x, b.vec_id as y from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.93
), reach(x, y) as (
    select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on l.x = r.y
), least as (
    select x, min(y) as component_id from reach group by x
), degrees as (
    select x, count(*) as n from links group by x
)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least l on l.x = e.vec_id left join degrees d on d.x = e.vec_id
""",
    "op7_near_duplicates": r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as x, b.doc_id as y, count(*) as both_n
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
    select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where 100 * both_n >= 80 * (p.n + q.n - both_n)
), reach(x, y) as (
    select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on l.x = r.y
), least as (
    select x, min(y) as component_id from reach group by x
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on x = d.doc_id left join sizes using (doc_id)
""",
    "op10_repeated_strings": """
with texts as (
    select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), places as (
    select r, p, md5(h[2 * p + 1:2 * p + 800]) as s from (select r, h, unnest(range(0, len(h) // 2 - 399)) as p from texts where len(h) >= 800)
), again as (
    select r, p from (select r, p, count(*) over (partition by s) as n from places) where n > 1
), runs as (
    select r, p, sum(fresh) over (partition by r order by p) as run
    from (select r, p, case when p > lag(p) over (partition by r order by p) + 400 then 1 else 0 end as fresh from again)
), spans as (
    select r, min(p) as a, max(p) + 400 as b from runs group by r, run
), kept as (
    select r, a, coalesce(lag(b) over (partition by r order by a), 0) as from_, b from spans
), glued as (
    select r, count(*) as n_spans, sum(b - a)::bigint as n_removed, max(b) as last_, string_agg(h[2 * from_ + 1:2 * a], '' order by a) as head
    from kept join texts using (r) group by r
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(k)) as kept_sha256,
    decode(unhex(array_to_string(regexp_extract_all(k, '([0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)|..', 1), ''))) as text
from (select *, coalesce(head, '') || h[2 * coalesce(last_, 0) + 1:] as k from texts left join glued using (r))
""",
    "op11_fill_in_middle": r"""
with drawn as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
    from documents
), ranks as (
    select doc_id, text, tokens, len(tokens) as n, ('0x' || h[1:8])::bigint % (len(tokens) + 1) as a, ('0x' || h[9:16])::bigint % (len(tokens) + 1) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
            when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') as prefix, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') as middle,
        array_to_string(tokens[greatest(a, b) + 1:n], '') as suffix
    from ranks
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from parts
""",
    "op12_filter_audit": r"""
with first as (
    select text, min(doc_id) as doc_id from (select coalesce(text, '') as text, doc_id from documents) group by 1
), judged as (
    select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by 1
), texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), masks as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, case when len(words) < 200 then 1 else 0 end
        + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
        + case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) then 4 else 0 end
        + case when regexp_matches(t.text, '[#$%&*|]') then 8 else 0 end + case when f.doc_id < t.doc_id then 16 else 0 end as mask
    from texts t left join first f on f.text = t.text left join judged j on j.doc_id = t.doc_id
), cells as (
    select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from masks group by 1, 2
), letters as (
    select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(letter, bit)
), orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letters a, letters b, letters c, letters d, letters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
    select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from (select *, unnest(range(1, 6)) as step from orders)
), counted as (
    select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & bit > 0 and mask & before > 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost
    from cells, steps group by 1, 2, 3, 4
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from counted
""",
}
