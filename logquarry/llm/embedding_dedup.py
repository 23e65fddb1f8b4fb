"""Near-duplicate embeddings: stored binary codes choose and bound the pairs whose cosine is computed.

A vector is turned by random rotations and kept as the signs of all turned coordinates, with a
correction factor: the inner product of the turned unit vector and its code.  Codes and factors are
written once, and everything up to the last step reads them, not the vectors:

* Stretches of BITS signs are buckets.  Two vectors at the threshold agree on one with probability
  (1 - angle/pi)**BITS, and a code has so many stretches that all of them miss with chance MISS.
* Within a bucket, the share of signs that differ is an unbiased estimate of the angle; only rows with
  a partner whose angle may still reach the threshold, SIGMAS standard errors allowed, go on.
* Their vectors are fetched.  A code's inner product with the other's turned vector, divided by the
  code's factor, estimates the cosine without bias, and the factor bounds its error.  Pairs whose upper
  bound reaches the threshold are computed exactly, in double precision.

Equal vectors are one row throughout, and a bucket yields counts and a spanning edge for each row, so
groups of copies are never listed as pairs.  Large buckets are divided into blocks that meet two by two.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.components import components
from logquarry.llm.tables import drop, save, small

#: Signs of a bucket, chance that a pair at the threshold shares no bucket, rows of a block of a bucket.
BITS, MISS, BLOCK = 16, 5e-3, 512
#: Standard errors of an estimate up to which its pair goes on.
SIGMAS = 6.0


def tables_needed(bits: int, threshold: float, miss: float = MISS) -> int:
    """Buckets that each vector joins so that a pair at the threshold is missed with chance miss."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


_kept: dict[tuple[int, int], np.ndarray] = {}


def rotations(dim: int, signs: int, seed: int = 11) -> np.ndarray:
    """So many random orthogonal matrices side by side that a turned vector has signs coordinates."""
    n = math.ceil(signs / dim)
    if (dim, n) not in _kept:
        random = np.random.default_rng([seed, dim])
        turns = [np.linalg.qr(random.normal(size=(dim, dim))) for _ in range(n)]
        _kept[dim, n] = np.hstack([q * np.sign(np.diag(r)) for q, r in turns]) / math.sqrt(n)
    return _kept[dim, n]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # squares of tiny or huge components stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(unit: np.ndarray, signs: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs of the turned unit rows as 0 and 1, correction factors)."""
    turned = unit @ rotations(unit.shape[1], signs)
    return turned > 0, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def _coded(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """group, rep, n, kind (of label and length), code (all signs, packed), factor, buckets: one for each table."""
    power = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        kinds, packed, factors, buckets = [], [], [], []
        for label, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            code, factor = codes(_unit(np.array([raw], np.float64)), bits * tables)
            seed = xxhash.xxh3_64_intdigest(f"{len(raw)} {label}")
            stretches = (code[0, : bits * tables].reshape(tables, bits) @ power).tolist()
            kinds.append(seed - (1 << 63))
            packed.append(np.packbits(code[0]).tobytes())
            factors.append(float(factor[0]))
            buckets.append([xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), (seed + t) % (1 << 64)) - (1 << 63) for t, k in enumerate(stretches)])
        made = [pa.array(kinds, pa.int64()), pa.array(packed, pa.binary()), pa.array(factors, pa.float64()), pa.array(buckets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["group", "rep", "n", "kind", "code", "factor", "buckets"])


_KEY = ["bucket", "x", "y"]


def _by_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What work makes of whole runs of rows with equal keys, and of where they begin and end; rows come
    sorted by key."""
    held = None
    for batch in chain(batches, (None,)):
        if batch is not None:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if held is None:
            return
        keys = [held[c].to_numpy() for c in _KEY]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), *([held.num_rows] if batch is None else [])]
        if len(cuts) > 1:
            yield from work(held.slice(0, cuts[-1]), cuts)
            held = held.slice(cuts[-1])


def _signs(data: pa.Table) -> np.ndarray:
    """Packed codes of equal length as rows of bytes."""
    raw = data["code"].to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _pairs(data: pa.Table, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j where a block meets itself) across the two blocks that meet in this table first and
    whose codes allow the threshold."""
    table, x, y = (data[c][0].as_py() for c in ("no", "x", "y"))
    code, block = _signs(data), data["block"].to_numpy()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    total = 8 * code.shape[1]
    differ = np.zeros((len(left), len(right)), np.int32)
    for a, b in zip(code[left].T, code[right].T):
        differ += np.bitwise_count(a[:, None] ^ b[None, :])
    i, j = np.nonzero(differ <= _farthest(total, threshold))
    i, j = left[i], right[j]
    if x == y:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        stretches = _stretches(code, bits, table)
        fresh = ~(stretches[i] == stretches[j]).any(1)
        i, j = i[fresh], j[fresh]
    return i, j


def _kinds(data: pa.Table) -> Iterator[pa.Table]:
    """The rows of one block pair by kind: buckets of different labels can share a number by chance."""
    kind = data["kind"].to_numpy()
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        if len(mine) > 1:
            yield data.take(pa.array(mine)).combine_chunks()


def _farthest(signs: int | np.ndarray, threshold: float) -> float | np.ndarray:
    """How many of so many signs may differ between vectors at the threshold."""
    at = math.acos(threshold) / math.pi
    return signs * at + SIGMAS * np.sqrt(signs * at * (1 - at))


def _stretches(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The numbers of packed codes' first stretches."""
    return np.unpackbits(code, axis=1)[:, : bits * tables].reshape(len(code), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _open(data: pa.Table, cuts: list[int], bits: int, threshold: float, few: int = 12) -> Iterator[pa.RecordBatch]:
    """The rows of each block pair that have a partner.

    Most block pairs have two or three rows: up to few, pairs of rows equally far apart are taken from all
    of them at once, with the same result.
    """
    wide = data.select(["group", "no", *_KEY, "block"])
    sizes = np.diff(cuts)
    left = np.concatenate([np.arange(n, 0, -1) if n <= few else np.zeros(n, int) for n in sizes.tolist()])  # rows to the end of a short run
    no, x, y, block, kind = (data[c].to_numpy() for c in ("no", "x", "y", "block", "kind"))
    raw = data["code"].to_pylist()
    signs = 8 * np.array([len(r) for r in raw])
    code = np.frombuffer(b"".join([r.ljust(signs.max() // 8, b"\0") for r in raw]), np.uint8).reshape(len(raw), -1)
    hit = np.zeros(len(raw), bool)
    for apart in range(1, few):
        i = np.flatnonzero(left > apart)
        j = i + apart
        meet = (kind[i] == kind[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
        i, j = i[meet], j[meet]
        near = np.bitwise_count(code[i] ^ code[j]).sum(1, dtype=np.int64) <= _farthest(signs[i], threshold)
        for p, q in zip(i[near].tolist(), j[near].tolist()):
            first, second = _stretches(code[[p, q]], bits, int(no[p]))
            if not (first == second).any():  # no earlier table has met the pair
                hit[p] = hit[q] = True
    if hit.any():
        yield wide.take(pa.array(np.flatnonzero(hit))).combine_chunks().to_batches()[0]
    for k in np.flatnonzero(sizes > few).tolist():
        for part in _kinds(data.slice(cuts[k], int(sizes[k]))):
            rows = np.unique(np.concatenate(_pairs(part, bits, threshold)))
            if len(rows):
                yield part.select(wide.column_names).take(pa.array(rows)).combine_chunks().to_batches()[0]


def near_pairs(a: np.ndarray, b: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit rows of a and b may have a cosine of threshold: their estimates' upper bounds reach
    it.  code and factor are those of a's rows."""
    turned = b @ rotations(b.shape[1], code.shape[1])
    signs = np.where(code[:, : turned.shape[1]], np.float32(1), np.float32(-1))
    estimate = signs @ turned.T.astype(np.float32) / (math.sqrt(turned.shape[1]) * factor[:, None])
    error = np.sqrt(np.maximum(1 - factor * factor, 0) / max(1, b.shape[1] - 1)) / factor
    return estimate + SIGMAS * error[:, None] + 1e-5 >= threshold


def _links(data: pa.Table, cuts: list[int], bits: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each block pair: for each row that has some (group, rep, rows behind its links that no earlier
    table has met, least rep that the links lead to)."""
    for part in (p for a, b in zip(cuts, cuts[1:]) if b - a > 1 for p in _kinds(data.slice(a, b - a))):
        i, j = _pairs(part, bits, threshold)
        group, rep, n, factor = (part[c].to_numpy() for c in ("group", "rep", "n", "factor"))
        raw = part["vec"].to_pylist()
        unit = _unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))
        code = np.unpackbits(_signs(part), axis=1).astype(bool)
        left, right = np.unique(i), np.unique(j)
        if len(i):
            may = near_pairs(unit[left], unit[right], code[left], factor[left], threshold)
            may = may[np.searchsorted(left, i), np.searchsorted(right, j)]
            i, j = i[may], j[may]
        near = [(unit[i[k : k + 32768]] * unit[j[k : k + 32768]]).sum(1) >= threshold for k in range(0, len(i), 32768)]
        near = np.concatenate(near) if near else np.empty(0, bool)
        i, j = i[near], j[near]
        count, least = np.zeros(len(rep), np.int64), rep.copy()
        np.add.at(count, i, n[j])
        np.add.at(count, j, n[i])
        while len(i):  # the least rep that each row's links lead to
            before = least.copy()
            np.minimum.at(least, i, least[j])
            np.minimum.at(least, j, least[i])
            if (least == before).all():
                break
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (group[some], rep[some], count[some], least[some])], names=["group", "rep", "links", "other"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["group", "vec"])


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, bits: int = BITS) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    threshold at least.  Null, empty and zero vectors, those with null or non-finite components and
    those of other lengths link with nothing.  Rows that share a vec_id count as one node for
    components, and each of them counts among others' links; a null vec_id links with nothing and is
    kept.  Further columns are ignored.

    bits: signs of a bucket, the same whatever the table's size, so which pairs meet does not depend on it.
    """
    base = vectors.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"))
    sound = "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0"
    sound += " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    same = F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64(F.lit("b"), "embedding", "label").alias("b"))
    rows = save(base.withColumn("same", F.when(F.coalesce(F.expr(sound), F.lit(False)), same)))
    named = rows.where("same is not null")
    groups = save(named.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("group", F.monotonically_increasing_id()))
    one = named.join(small(groups), "same").where("vec_id = rep")  # a group's vector
    if named.groupBy("vec_id").count().where("count > 1").limit(1).count():
        one = one.dropDuplicates(["group"])
    tables = tables_needed(bits, threshold)
    coded = save(
        one.select("group", "rep", "n", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(
            lambda b: _coded(b, bits, tables), "group long, rep long, n long, kind long, code binary, factor double, buckets array<long>"
        )
    )
    keys = coded.select("group", F.posexplode("buckets").alias("no", "bucket"))
    shared = save(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # Each row goes to every pair of blocks that its own block is part of.
    placed = (
        keys.join(small(shared), "bucket")
        .withColumn("blocks", F.expr("cast(ceil(size / {0}) as int)".format(BLOCK)))
        .withColumn("block", F.expr("cast(pmod(xxhash64(group, 5), blocks) as int)"))
        .join(coded.select("group", "kind", "code"), "group")
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("group", "kind", "code", "no", "bucket", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block")
    )

    def by_key(df: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        return save(df.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(lambda b: _by_key(b, lambda t, cuts: work(t, cuts, bits, threshold)), schema))

    open_ = by_key(placed, _open, "group long, no int, bucket long, x int, y int, block int")
    drop(shared)
    some = small(save(open_.select("group").distinct()))
    vecs = one.join(some, "group", "left_semi").select("group", "embedding").mapInArrow(_vectors, "group long, vec binary")
    full = save(coded.drop("buckets").join(vecs, "group"))
    found = by_key(open_.join(full, "group"), _links, "group long, rep long, links long, other long")
    drop(full, open_)
    counts = found.groupBy("group").agg(F.sum("links").alias("links"))
    tied = save(named.join(small(groups), "same").select("vec_id", "group", "rep", "n"))
    edges = found.select(F.col("rep").alias("a"), F.col("other").alias("b")).unionByName(tied.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    tree = save(components(edges))
    links = save(tied.join(counts, "group", "left").groupBy("vec_id").agg(F.max(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    return (
        rows.select("vec_id")
        .join(small(links), "vec_id", "left")
        .join(small(tree), F.col("vec_id") == F.col("node"), "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
