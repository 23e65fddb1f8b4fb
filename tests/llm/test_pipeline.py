"""The pipeline on a small corpus whose fate is known document by document."""

import random
import zlib

import numpy as np

import corpus_pipeline
from logquarry.llm.tables import save
from logquarry.llm.tokens import Encoder, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlcum") for _ in range(r.randint(3, 9))) for _ in range(n))


def corpus():
    """(rows, labels, what is left of each kept text)."""
    r = random.Random(8)
    rows, labels, kept = [], [], {}

    def add(text, want=None):
        i = len(rows)
        rows.append((i, text, "en", f"src{i % 3}", len(text or "")))
        if want is not None:
            kept[i] = want
        return i

    for _ in range(150):  # clean and labelled so
        t = prose(r, r.randint(60, 150))
        labels.append((add(t, t), 0))
    for k in range(80):  # toxic, half of them labelled
        words = prose(r, 80).split()
        for w in r.sample(["vile", "nasty", "filthy"], 3) * 2:
            words.insert(r.randrange(len(words)), w)
        i = add(" ".join(words))
        if k % 2:
            labels.append((i, 1))
    for t in (None, "", "too short", "again and again " * 60):  # fail the quality rules
        add(t)
    base = prose(r, 120)
    add(base, base)
    add(base)
    near = base.split()
    near[60] = "zzz"
    add(" ".join(near))
    passage = prose(r, 80)
    for _ in range(3):  # share a passage, and nothing else
        a, b = prose(r, 400), prose(r, 400)
        add(f"{a}|{passage}|{b}", None)
        kept[len(rows) - 1] = (a, b, passage)
    return rows, labels, kept


def test_pipeline(spark, make, tmp_path):
    rows, labels, kept = corpus()
    make(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    make(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            left = {x["doc_id"]: x for x in docs.collect()}
    assert left.keys() == kept.keys()
    for i, want in kept.items():
        got = left[i]
        assert got["n_chars"] == len(got["text"]) and (got["lang"], got["source"]) == ("en", f"src{i % 3}")
        if isinstance(want, tuple):
            a, b, passage = want
            assert got["text"] == a + b and passage not in got["text"]  # the bars repeat with the passage
        else:
            assert got["text"] == want
    tokenizer = Encoder(vocabulary("word_bpe_49k.json")).tokenizer
    ids = {i: np.array(tokenizer.encode(x["text"], add_special_tokens=False).ids + [0], "<u4") for i, x in left.items()}
    packed = docs.collect()
    assert sum(p["length"] for p in packed) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in packed)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((p["doc_id"], p["ids_crc32"]) for p in again.collect()) == sorted((p["doc_id"], p["ids_crc32"]) for p in packed)


def test_repeated_rows_and_null_ids_lose_no_document(spark, make):
    """Stage by stage: one row of each text stays whole, whatever its id."""
    r = random.Random(3)
    a, b, c, d, e = (prose(r, 120) for _ in range(5))
    near = c.replace(c.split()[50], "zzz", 1)
    rows = [(1, a), (1, a), (2, b), (3, c), (3, d), (None, e), (None, e), (None, b), (7, near), (8, None), (8, ""), (None, None)]
    docs = make([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.count() == 9
    one = save(corpus_pipeline.near_dedup(spark, docs, ""))
    got = sorted(((x["doc_id"] or 0, x["text"]) for x in one.collect()), key=str)
    # c stands beside d under one id, so the row with an id of its own is the one that stays.
    assert got == sorted([(1, a), (2, b), (3, d), (0, e), (7, near), (8, None), (8, ""), (0, None)], key=str)
    cut = sorted((x["doc_id"] or 0, x["text"]) for x in corpus_pipeline.suffix_dedup(spark, one, "").collect())
    assert cut == sorted([(1, a), (2, b), (3, d), (0, e), (7, near)])
    assert corpus_pipeline.packing(spark, one, "").count() == len(got)


def test_empty_tables(spark, make, tmp_path):
    make([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    make([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
