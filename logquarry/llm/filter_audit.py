"""How quality filters interact: what each removes, alone and behind others, in every order.

Texts are scanned once, straight in Arrow's buffers: NumPy tells each byte's class, prefix sums over the
classes count words, capitals and symbols of all texts of a batch together, and prefix sums of weighted
bytes give each word a hash.  A text's hashes are sorted, equal neighbours are compared byte by byte, and
what differs from its neighbour is a distinct word.

A document then is a mask of the filters that it fails.  Which document fails which filter does not
depend on the order, so counts by part and mask (32 at most for five filters) hold all that any order
can ask; orders are worked out on these counts, not on documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.tables import save, text_bytes, with_carried
from logquarry.llm.tokens import slices

#: Bits of a byte's class.
BLANK, CAPITAL, SYMBOL, FURTHER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] = BLANK
_CLASS[65:91] = CAPITAL
_CLASS[[ord(c) for c in "#$%&*|"]] = SYMBOL
_CLASS[128:192] = FURTHER  # not the first byte of a code point

_WEIGHT = np.random.default_rng(20240612).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes whose weighted sums are held at once.
_WINDOW = 1 << 22
#: The first k bytes of eight, as a little-endian number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SCHEMA = "doc_id long, n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long, text_sha256 binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts of many texts that lie one behind the other."""

    def __init__(self, window: int = _WINDOW):
        self.window = window
        self.up = self.down = np.empty(0, np.uint64)

    def word_hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word data[start:end], from differences of weighted prefix sums."""
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, low + self.window, "right")))
            n = int(end[to - 1]) - low
            if len(self.up) <= n:
                self.up, self.down = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(_WEIGHT[data[low : low + n]] * self.up[:n], out=sums[1:])
                h = (sums[end[at:to] - low] - sums[start[at:to] - low]) * self.down[start[at:to] - low]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0x9E3779B97F4A7C15)
                out[at:to] = h ^ h >> np.uint64(29)
            at = to
        return out

    def distinct(self, data: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """How many different words each of n texts has; text: the number of each word's text, rising."""
        h = self.word_hashes(data, start, end) if hashes is None else hashes
        bits = np.uint64(max(1, (n - 1).bit_length()))
        key = text.astype(np.uint64) << np.uint64(64) - bits | h >> bits
        order = np.argsort(key)
        key = key[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = order[same], order[same + 1]
        out = np.bincount(text, minlength=n) - np.bincount(text[a], minlength=n)
        differ = ~_equal(data, start[a], start[b], end[a] - start[a], end[b] - start[b])
        for t in np.unique(text[a[differ]]).tolist():  # a hash that two words share: count this text's words themselves
            i, j = np.searchsorted(text, (t, t + 1))
            out[t] = len({data[x:y].tobytes() for x, y in zip(start[i:j].tolist(), end[i:j].tolist())})
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words, distinct words, capitals, symbols and code points of each text data[offsets[i]:offsets[i + 1]]."""
        kind = _CLASS[data]
        n = len(offsets) - 1

        def each(mask: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        inside = kind & BLANK == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]  # words end where their text does
        first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = each(first)
        text = np.repeat(np.arange(n), words)
        distinct = self.distinct(data, text, start, end, n)
        return words, distinct, each(kind & CAPITAL != 0), each(kind & SYMBOL != 0), each(kind & FURTHER == 0)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether data[a:a + n] and data[b:b + m] are the same bytes, eight by eight."""
    out = n == m
    if not len(a):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left, who = n.copy(), np.flatnonzero(out)
    a, b = a.copy(), b.copy()
    while len(who):
        differ = (eight[a[who]] ^ eight[b[who]]) & _HEAD[np.minimum(left[who], 8)]
        out[who[differ != 0]] = False
        a[who] += 8
        b[who] += 8
        left[who] -= 8
        who = who[(left[who] > 0) & (differ == 0)]
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        for part in slices(batch):
            texts = part.column(1).fill_null(b"").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
            offsets = offsets - offsets[0]
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            made = [pa.array(c, pa.int64()) for c in scanner.counts(data, offsets)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made, pa.array(digests, pa.binary()), *part.columns[2:]], names=names + part.schema.names[2:])


def text_facts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_distinct, n_capitals (A-Z), n_symbols
    (# $ % & * |), n_points (code points), text_sha256.

    Words are runs without blanks, compared as they stand.  A null text is empty; repeated rows and null ids
    are counted each by itself.  The columns named by carry come in a struct, carried.  Narrow: no shuffle.
    """
    return text_bytes(docs, carry).mapInArrow(_facts, with_carried(SCHEMA, docs, carry))


#: Filters by letter: what fails, in the columns of text_facts() and copy (the text of a lesser doc_id too).
FILTERS: Mapping[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_capitals") > 2 * F.col("n_points"),
    "D": lambda: F.col("n_symbols") > 0,
    "E": lambda: F.col("copy"),
}


def _with_copies(facts: DataFrame) -> DataFrame:
    """facts (a saved table) with copy: whether a row with a lesser doc_id has the same text.

    The first of each text is found by a minimum that combines on the map side, and joined by text and
    doc_id: rows of a text that a third of the corpus has are dealt by their ids.
    """
    first = facts.where("doc_id is not null").groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    return facts.join(first, ["text_sha256", "doc_id"], "left").withColumn("copy", F.col("_first").isNull() & F.col("doc_id").isNotNull()).drop("_first")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each
    source of docs (doc_id, text, source) and each order of all filters, what each step does.

    kept and removed count documents after and in the step; redundant those that fail its filter but went
    before; unique_fails those that fail no other; good_lost and toxic_lost those removed here that labels
    (doc_id, quality, toxic) call good or toxic; shapley is what its filter removes, summed over all orders.

    A null text is empty, a null source is the part ''.  A row without a doc_id is no copy and makes none;
    rows that repeat an id and text are no copies of each other, and count each.  A document with several
    labels is good (toxic) if one of them says so; one without labels is neither.  No documents, no rows.
    """
    letters = "".join(filters)
    facts = save(text_facts(docs, ["source"]).select("*", F.coalesce("carried.source", F.lit("")).alias("part")).drop("carried"))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    fails = [F.when(test(), 1 << i).otherwise(0) for i, test in enumerate(filters.values())]
    masks = _with_copies(facts).select("doc_id", "part", sum(fails, F.lit(0)).alias("mask"))
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    cells = masks.join(judged, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # one for each mask at most
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [
        {"filter_order": order, "step": k + 1, "bit": bit[x], "before": sum(bit[y] for y in order[:k])}
        for order in map("".join, itertools.permutations(letters)) for k, x in enumerate(order)
    ]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    total = lambda value, test: F.expr(f"aggregate(cells, 0L, (sum, x) -> sum + if({test}, {value}, 0L))")
    here = "x.mask & bit > 0 and x.mask & before = 0"
    return parts.select("part", "cells", F.explode(literal).alias("_s")).select("part", "cells", "_s.*").select(
        "part", "filter_order", "step",
        total("x.n", "x.mask & (before | bit) = 0").alias("kept"), total("x.n", here).alias("removed"),
        total("x.n", "x.mask & bit > 0 and x.mask & before > 0").alias("redundant"), total("x.n", "x.mask = bit").alias("unique_fails"),
        total("x.good", here).alias("good_lost"), total("x.toxic", here).alias("toxic_lost"),
        total(f"x.n * ({math.factorial(len(letters))}L div bit_count(x.mask))", "x.mask & bit > 0").alias("shapley"),  # a k-th of all orders
    )
