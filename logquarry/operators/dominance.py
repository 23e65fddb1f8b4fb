"""Counting of pairs in two orders at once, without meeting them pair by pair.

A match counts earlier ones that had both arrived before it and lie before an instant.  Arrivals are cut
into blocks of ids, times into slices by quantiles.  What comes before a match in both orders then is

* all of the cells (block, slice) before its own in both: sums over a small table of cells,
* those of its own slice from earlier blocks: counted within the slice,
* those of its own block: counted within the block.

Each of the three is the same question about fewer rows, and each row takes part in three groups of
bounded size, so the work is shuffled a few times whatever its number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrival ids of a block, and slices of a group's times.
BLOCK, SLICES = 1 << 16, 64


def count_before(first: np.ndarray, second: np.ndarray, weight: np.ndarray, ask_first: np.ndarray, ask_second: np.ndarray) -> np.ndarray:
    """For each question the weight of the points with first < ask_first and second <= ask_second.

    Points are sorted by first.  A question's points by first are a prefix, which runs of 1, 2, 4, ...
    points make up; each run sorted by second has its weight up to a place in a running sum.
    """
    order = np.argsort(first, kind="stable")
    first, second, weight = first[order], second[order], weight[order]
    n = len(first)
    ends = np.searchsorted(first, ask_first, "left")  # how many points the prefix has
    by_second = np.argsort(second, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_second] = np.arange(n)
    upto = np.searchsorted(second[by_second], ask_second, "right")  # ranks below this one count
    out = np.zeros(len(ask_first), np.int64)
    place = np.arange(n)
    for level in range(max(n, 1).bit_length()):
        ask = np.flatnonzero(ends >> level & 1)
        if not len(ask):
            continue
        run = (ends[ask] >> level) - 1  # this level's run of each prefix
        keys = (place >> level) * (n + 1) + rank
        sorted_ = np.argsort(keys, kind="stable")
        sums = np.concatenate(([0], np.cumsum(weight[sorted_])))
        at = np.searchsorted(keys[sorted_], run * (n + 1) + upto[ask], "left")
        out[ask] += sums[at] - sums[run << level]
    return out


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """The answers of one group: its points, and two questions of each asking row."""
    points, asks = rows[rows["weight"] > 0], rows[rows["weight"] == 0]
    if not len(asks):
        return pd.DataFrame({"id": [], "n": []}).astype("int64")
    a = [points[c].to_numpy(np.int64) for c in ("first", "second", "weight")]
    ask = asks["first"].to_numpy(np.int64)
    n = count_before(*a, ask, asks["second"].to_numpy(np.int64)) - count_before(*a, ask, asks["low"].to_numpy(np.int64))
    return pd.DataFrame({"id": asks["id"].to_numpy(np.int64), "n": n})


def arrived_within(rows: DataFrame, same: Sequence[str], block: int = BLOCK, slices: int = SLICES) -> DataFrame:
    """id, n for the rows that ask: how many rows of their group (the columns of same) have an id up to theirs
    and a time from low to their own.

    rows: same, id (long, of one row each; those of the group's other rows too), us (time), low, asks
    (boolean).  A group may be of any size; blocks and slices bound what one task counts.
    """
    step = rows.withColumn("_block", F.floor(F.col("id") / block).cast("long"))
    cuts = step.groupBy(*same).agg(F.percentile_approx("us", F.lit([i / slices for i in range(1, slices)]), 1000).alias("_cuts"))
    slice_of = lambda c: F.aggregate("_cuts", F.lit(0).cast("long"), lambda n, cut: n + (cut < F.col(c)).cast("long"))
    # The time below the lowest that counts: what lies up to it is taken off again.
    step = step.join(cuts, list(same)).withColumn("_under", F.col("low") - 1).withColumn("_slice", slice_of("us")).withColumn("_low", slice_of("_under")).drop("_cuts")
    # Points have no id and no low; a null would turn the column, and ids with it, into floating point.
    zero = F.lit(0).cast("long")

    def part(kind: str, no, first, second, low, weight, id_):
        fields = {"kind": F.lit(kind), "no": no, "first": first, "second": second, "low": low, "weight": weight, "id": id_}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    us, under, b, s, id_ = (F.col(c) for c in ("us", "_under", "_block", "_slice", "id"))
    one = F.lit(1).cast("long")
    # In a block, points come by id and time; in a slice, by block and time: those of equal ones are one point.
    inside = step.select(*same, part("block", b, id_, us, zero, one, zero).alias("p")).unionByName(
        step.groupBy(*same, "_block", "_slice", "us").agg(F.count(F.lit(1)).alias("w")).select(*same, part("slice", s, b, us, zero, F.col("w"), zero).alias("p"))
    ).unionByName(step.groupBy(*same, "_block", "_slice").agg(F.count(F.lit(1)).alias("w")).select(*same, part("cell", zero, b, s, zero, F.col("w"), zero).alias("p")))
    asks = step.where("asks")
    # A question is asked of its block, of the cells, and of the slices of both of its times.
    never = F.lit(-(1 << 62)).cast("long")
    questions = F.array(
        part("block", b, id_ + 1, us, under, zero, id_), part("cell", zero, b, s - 1, F.col("_low") - 1, zero, id_),
        part("slice", s, b, us, never, zero, id_), part("slice", F.col("_low"), b, never, under, zero, id_),
    )
    both = inside.unionByName(asks.select(*same, F.explode(questions).alias("p"))).select(*same, "p.*")
    answers = both.groupBy(*same, "kind", "no").applyInPandas(_counted, "id long, n long")
    return answers.groupBy("id").agg(F.sum("n").alias("n"))
