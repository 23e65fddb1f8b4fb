"""Removal of byte strings that stand in a corpus more than once, wherever they begin.

Prefix doubling ranks positions by ever longer prefixes and drops those whose rank is theirs alone.
Ranking every byte position would move some thirty times the corpus in each sort, so two things change:

* Only content-defined anchors take part.  Every string of ``length`` bytes holds the least k-gram of
  its window at a place that its bytes alone decide (see anchors.py), so equal strings meet at an
  anchor.  An anchor stands for the strings whose window it is the least of: a range of distances
  between the string's start and the anchor.
* A rank is a 128-bit hash of the bytes, so ranks compare across tasks without a global sort; Spark
  groups by them.

Each round looks at shorter ranges of distances, and so at longer common strings: those that all
strings of a range share (a rank of one member: none of them repeats) and those that hold all of them
(a rank of several members: all of them repeat).  What is neither is divided and looked at again,
until a range is one string of full length.  One member of each settled rank stays on as a witness, as
others may share a part of its strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.anchors import anchors
from logquarry.llm.tables import drop, save, small, text_bytes, with_carried

#: Into how many ranges a round divides one, and how many rounds there are.
FAN, ROUNDS = 7, 3

_RANKED = "key binary, pos int, low int, high int, open boolean, shared long, whole binary"


def _first_ranks(batches: Iterator[pa.RecordBatch], length: int, fan: int) -> Iterator[pa.RecordBatch]:
    span = fan**ROUNDS
    k = length - span + 1
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        row, pos, low, high, shared, whole = [], [], [], [], [], []
        for i, data in enumerate(texts):
            place, grams, first, last = anchors(data, k, span)
            row.append(np.full(len(place), i))
            pos.append(place)
            low.append(place - last)
            high.append(place - first)
            shared.append(grams.view(np.int64))
            for a, b in zip(first.tolist(), last.tolist()):
                whole.append(xxhash.xxh3_128_digest(data[a : b + length], 0))
        if not whole:
            continue
        low, high = np.concatenate(low), np.concatenate(high)
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(np.concatenate(row))),
                pa.array(np.concatenate(pos), pa.int32()),
                pa.array(low, pa.int32()),
                pa.array(high, pa.int32()),
                pa.array(np.ones(len(low), bool)),
                pa.array(np.concatenate(shared)),
                pa.array(whole, pa.binary()),
            ],
            names=["key", "pos", "low", "high", "open", "shared", "whole"],
        )


def _next_ranks(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the ranges of width distances that meet the open ranges of a text's anchors."""
    for batch in batches:
        rows = []
        for key, data, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for item in found:
                pos, least, most = item["pos"], item["low"], item["high"]
                for block in range(least // width, most // width + 1):
                    a, b = block * width, block * width + width - 1
                    # A range that leaves the text has no string that holds all of it.
                    inside = pos - b >= 0 and pos - a + length <= len(data)
                    rows.append(
                        (
                            key,
                            pos,
                            max(a, least),
                            min(b, most),
                            item["open"],
                            xxhash.xxh3_64_intdigest(data[pos - a : pos - b + length], block) - (1 << 63),
                            xxhash.xxh3_128_digest(data[pos - b : pos - a + length], block) if inside else None,
                        )
                    )
        if rows:
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "pos", "low", "high", "open", "shared", "whole"]
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, data, copies, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            merged: list[list[int]] = []
            if copies and len(data) >= length:
                merged = [[0, len(data)]]
            elif spans:
                for s in sorted((s["start"], s["end"]) for s in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            text = kept.decode("utf-8", "ignore")  # a cut may leave part of a character
            rows.append((doc_id, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), text))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *batch.schema.names[4:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *batch.columns[4:]], names=names)


def _lists(df: DataFrame) -> DataFrame:
    """A table of places by text, to be joined with texts.  It grows with the corpus, and its lists more in
    memory than in files, so it is never broadcast: both sides are dealt by key, its parts are hashed."""
    return df.hint("shuffle_hash")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, length: int = 400, fan: int = FAN, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text) without the bytes that repeated strings cover.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in this row or
    another; strings do not cross rows, and are judged on the input.  Gives doc_id, n_bytes, n_removed,
    n_spans (runs of removed bytes), kept_sha256 (of the remaining bytes) and kept_text (the same without
    broken characters); the columns named by carry come in a struct, carried.  A null text is empty.
     Rows with equal texts, equal ids included, are each other's repeats; ids may be null.
    """
    if length - fan**ROUNDS + 1 < 16:
        raise ValueError(f"strings of {length} bytes are too short for fan {fan}")
    texts = text_bytes(docs, carry).withColumn("text", F.coalesce("text", F.lit(b""))).withColumn("key", F.unhex(F.md5("text")))
    # Texts that stand more than once vanish whole; one row of them speaks for all to the others.
    copies = small(save(
        texts.where(F.length("text") >= length)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
        .where("copies > 1")
        .drop("copies")
    ))
    single = (
        texts.where(F.length("text") >= length)
        .join(copies, "key", "left")
        .where("first is null or first <=> doc_id")
        .select("key", "text")
    )
    place = F.xxhash64("key", "pos", "low")
    content = F.xxhash64("whole")
    ranked = save(single.mapInArrow(lambda b: _first_ranks(b, length, fan), _RANKED))
    done: list[DataFrame] = []
    width = fan**ROUNDS
    while True:
        # Ranks of several places that some open range has; mixed if their members differ further out.  A rank
        # can be very common: its table is written, so that the join's sides are dealt anew and split by skew.
        ranks = save(
            ranked.groupBy("shared")
            .agg(
                F.min(place).alias("x"), F.max(place).alias("y"), F.max("open").alias("any"),
                F.min(content).alias("a"), F.max(content).alias("b"), F.count("whole").alias("n"), F.count(F.lit(1)).alias("m"),
            )
            .where("x <> y and any")
            .select("shared", F.expr("n < m or a <> b").alias("mixed"))
        )
        shared = save(ranked.join(small(ranks), "shared").drop("shared"))
        drop(ranked, ranks)
        same = save(shared.where("whole is not null").groupBy("whole").agg(F.min(place).alias("witness"), F.max(place).alias("y")).where("witness <> y").drop("y"))
        state = save(
            shared.join(small(same), "whole", "left").select(
                "key", "pos", "low", "high", "open", "mixed",
                F.col("witness").isNotNull().alias("again"), F.coalesce(F.col("witness") == place, F.lit(False)).alias("witness"),
            )
        )
        drop(shared, same)
        done.append(state.where("open and again"))
        if width == 1:
            break
        width //= fan
        rest = state.where("mixed and (not again or witness)").withColumn("open", F.expr("open and not again"))
        rest = save(rest.groupBy("key").agg(F.collect_list(F.struct("pos", "low", "high", "open")).alias("found")))
        ranked = save(
            single.join(_lists(rest), "key").select("key", "text", "found").mapInArrow(lambda b, w=width: _next_ranks(b, length, w), _RANKED)
        )
        drop(rest)
    spans = None
    for rows in done:
        rows = rows.select("key", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end")).alias("span"))
        spans = rows if spans is None else spans.unionByName(rows)
    spans = _lists(save(spans.groupBy("key").agg(F.collect_list("span").alias("spans"))))
    return (
        texts.join(copies.select("key", F.lit(True).alias("copies")), "key", "left")
        .join(spans, "key", "left")
        .select("doc_id", "text", "copies", "spans", *(["carried"] if carry else []))
        .mapInArrow(lambda b: _cut(b, length), with_carried(_OUT, docs, carry))
    )
