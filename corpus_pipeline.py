"""Corpus preparation in five stages, each a job over all that the stage before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.near_dedup import near_duplicates
from logquarry.llm.packing import pack
from logquarry.llm.quality import quality
from logquarry.llm.repeats import remove_repeats
from logquarry.llm.tables import save, small, table
from logquarry.llm.tokens import vocabulary
from logquarry.llm.toxicity import severity, train_on_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row; null and empty texts have too few words and go."""
    return quality(docs, COLUMNS).where("kept").select("carried.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, trained on the labelled rows among docs, does not call toxic.

    Row by row: null ids and repeated rows are judged by their texts; null and empty texts stay.
    """
    return severity(docs, train_on_labels(docs, table(spark, sf_dir, "labels")), COLUMNS).where("kept").select("carried.*")


def _one_number_each(docs: DataFrame) -> DataFrame:
    """docs with a column number that tells documents apart: the doc_id, where that is given and stands once.

    Rows that share a doc_id or have none get a number made of doc_id and text, greater than any id in use;
    those equal in both become one row (with the least of their other columns).
    """
    several = save(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")))
    if several.limit(1).count() + docs.where("doc_id is null").limit(1).count() == 0:
        return docs.withColumn("number", F.col("doc_id"))
    rows = docs.join(small(several), "doc_id", "left").withColumn("odd", F.expr("doc_id is null or several is not null"))
    once = rows.where("not odd").select(*COLUMNS, F.col("doc_id").alias("number"))
    number = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    odd = rows.where("odd").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*", number.alias("number"))
    return save(once.unionByName(odd.select(*COLUMNS, "number")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Of rows with equal doc_id and text one stays.  Other rows that share a doc_id, and rows without one, are
    documents of their own and stay only where no row with a doc_id of its own is like them.  Null and
    empty texts have no near-duplicates and stay.
    """
    rows = _one_number_each(docs)
    groups = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), width=5, percent=80)
    gone = save(groups.where("not kept").select(F.col("doc_id").alias("number")).distinct())
    return rows.join(small(gone), "number", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 256 bytes that stand elsewhere too; documents left with nothing go.

    Passages of fifty words have some 300 bytes; shorter repeats are common phrases.  Rows are texts of
    their own, whatever their doc_ids: null ids stay null.  Null texts and those without a sign other than
    blanks are left with nothing and go.
    """
    cut = remove_repeats(docs, length=256, fan=6, carry=["lang", "source"]).where("trim(kept_text) <> ''")
    return cut.select(
        "doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars")
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048.

    Row by row: null ids stay null, repeated rows are packed each, null and empty texts are one end id.
    """
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0, cache=80_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Compression ratios, the severity model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
