"""Best-fit packing of token sequences by exact-complement hashing on a length histogram.

Pieces of one length are alike, so the plan needs only how many there are of each length: at most
``capacity`` counts, whatever the corpus holds.  Lengths are taken from the longest down; a table of
single, pair and triple sums names combinations that fill a gap exactly, and each combination is used
as often as its counts allow.  What no combination completes is packed best-fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.tables import save, small, text_bytes
from logquarry.llm.tokens import CACHE, as_texts, encoder, slices

Pattern = tuple[list[int], int]


class Complements:
    """Lengths still available, by the sums that one, two or three of them make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        lengths = np.flatnonzero(counts)
        x, y = np.triu_indices(len(lengths))
        x, y = lengths[x], lengths[y]
        fits = x + y < len(counts)
        x, y = x[fits], y[fits]
        order = np.lexsort((-y, x + y))  # within a sum, the longest partner first
        self.x, self.y = x[order], y[order]
        self.first = np.searchsorted(self.x + self.y, np.arange(len(counts) + 1))
        #: Sums that a pair may still make; counts only fall, so what has gone stays gone.
        self.open = np.diff(self.first, append=len(self.x)) > 0

    def pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """An available pair with that sum; beside is a length that must stay available too."""
        a, b = self.first[total], self.first[total + 1]
        x, y = self.x[a:b], self.y[a:b]
        left = self.counts
        ok = (left[x] > (x == beside)) & (left[y] > (y == beside).astype(int) + (x == y))
        if ok.any():
            at = int(np.argmax(ok))
            return int(y[at]), int(x[at])
        if not beside:
            self.open[total] = False
        return None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.counts[gap]:
            return [gap]
        if found := self.pair(gap):
            return list(found)
        third = np.arange(1, max(gap - 1, 1))
        for c in third[(self.counts[third] > 0) & self.open[gap - third]][::-1].tolist():
            if self.pair(gap - c) and (found := self.pair(gap - c, c)):
                return [c, *found]
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths in a sequence, number of such sequences) that use up the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[Pattern] = []
    if counts[capacity]:
        patterns.append(([capacity], int(counts[capacity])))
        counts[capacity] = 0
    index = Complements(counts)
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1  # the piece whose gap is to be filled
            parts = index.fill(capacity - length)
            counts[length] += 1
            if parts is None:
                rest[length] = counts[length]
                counts[length] = 0
                break
            used = [length, *parts]
            times = min(int(counts[p]) // used.count(p) for p in used)
            for p in used:
                counts[p] -= times
            patterns.append((used, times))
    # Best-fit decreasing: bins that look alike are kept together, by the room left in them.
    bins: dict[int, list[Pattern]] = {}
    for length in range(capacity - 1, 0, -1):
        left = int(rest[length])
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, odd = divmod(left, each)
                for parts, n in (([length] * each, full), ([length] * odd, 1)):
                    if n and parts:
                        bins.setdefault(capacity - length * len(parts), []).append((parts, n))
                break
            parts, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // length, left)
            times = min(n, left // each)
            if times < n:
                bins.setdefault(room, []).append((parts, n - times))
            bins.setdefault(room - each * length, []).append((parts + [length] * each, times))
            left -= each * times
    return patterns + [p for same in bins.values() for p in same]


def slots(patterns: list[Pattern], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on its pieces take a place, that place's sequence and offset."""
    used = dict.fromkeys(range(1, capacity + 1), 0)
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for parts, times in patterns:
        offset = 0
        for length in parts:
            out.setdefault(length, []).append((used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, cache: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
    for batch in batches:
        for some in slices(batch):
            lists = encoder(path, cache).lists(as_texts(some.column(1)), end_id)
            cuts, data = lists.offsets.to_pylist(), memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            rows = []
            for doc_id, first, last in zip(some.column(0).to_pylist(), cuts, cuts[1:]):
                for k in range(first, last, capacity):
                    n = min(capacity, last - k)
                    rows.append((doc_id, (k - first) // capacity, k - first, n, zlib.crc32(data[4 * k : 4 * (k + n)]), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    places = shared.value
    for batch in batches:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            first, base, place = places[n]
            at = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine] = base[at] + rank[mine] - first[at]
            offset[mine] = place[at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache: int = CACHE) -> DataFrame:
    """Pack every text of docs (doc_id, text) into sequences of at most capacity ids.

    A text's ids end with end_id; only texts of more than capacity ids are cut.  Gives doc_id, piece,
    start, length, ids_crc32, sequence_id and offset.  A null text is empty and becomes one piece of
    length 1; null or repeated doc_ids are packed row by row; further columns are ignored.  An empty
    table gives an empty one.  cache: stretches of text whose ids a worker remembers, for workers that
    keep memory for other steps too.

    A piece's rank among those of its length is its place in its input partition plus what earlier
    partitions hold of that length, so ranking moves one row for each partition and length.  The plan
    is made on the driver from at most capacity counts.
    """
    spark = docs.sparkSession
    pieces = save(
        text_bytes(docs).mapInArrow(
            lambda b: _pieces(b, tokenizer_path, capacity, end_id, cache),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long",
        )
    )
    here = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = save(here.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))
    return (
        pieces.join(small(bases).drop("n"), ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
        .mapInArrow(
            lambda b: _placed(b, places),
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
