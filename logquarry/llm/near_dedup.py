"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

Every hash of a shingle serves twice: a permutation's least and greatest values are both kept, so
PERMS evaluations give 2 * PERMS signature values.  Bands take ROWS values of different permutations;
two documents that agree on a band become candidates.  At similarity 0.8 a pair shares no band with
probability (1 - 0.8**4)**20 < 3e-5, less for closer pairs.

Candidates are compared on their full sets, and only as far as components need it: each band bucket
first links its members to one of them, then buckets that still hold several components try two
more.  Buckets that are still open are compared last, each by itself and whatever its size: the members
outside its main component with all its members, as products of set blocks in numpy, which list no
pairs but a spanning edge for each row.  So a group of copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.components import components
from logquarry.llm.tables import save, small, text_bytes

PERMS, ROWS = 40, 4
BANDS = 2 * PERMS // ROWS
#: Bit masks that order ids differently; the first (none) makes the least id the one to compare with.
_MASKS = ((0,), (0x2AAA_AAAA_AAAA_AAAA, 0x5555_5555_5555_5555))
#: Rows of a block of sets, and rows of a block pair up to which it is compared pair by pair.
BLOCK, FEW = 384, 12

_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fold(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (its whole word sequence if shorter)."""
    words = text.lower().split()  # bytes: A-Z alone is lowered, and only the six ASCII blanks divide
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return np.unique(_fold(out))


def signature(items: np.ndarray) -> np.ndarray:
    """The bands' hashes: least values fill the first half of them, greatest values the second."""
    low, high = np.full(PERMS, ~np.uint64(0)), np.zeros(PERMS, np.uint64)
    for at in range(0, len(items), 2048):
        h = items[at : at + 2048, None] * _A + _B
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    values = np.concatenate((low, high)).reshape(BANDS, ROWS)
    return _fold((values * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, prints, bands = batch.column(0), [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py() or b"", width)
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(signature(s).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "print", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py() or b"", width).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "items"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            small_, large = min(len(x), len(y)), max(len(x), len(y))
            if 100 * small_ < percent * large:
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


_BUCKET = ["band", "hash"]
_BLOCKS = [*_BUCKET, "x", "y"]


def _block_links(data: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rep, least rep that its links lead to) for rows of one block pair with links across components."""
    rep, component, block = (data[c].to_numpy() for c in ("rep", "component", "block"))
    x, y = data["x"][0].as_py(), data["y"][0].as_py()
    sets = [np.frombuffer(v, np.uint64) for v in data["items"].to_pylist()]
    sizes = np.array([len(v) for v in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[item] > 1
    row, item = row[shared], np.cumsum(times > 1)[item[shared]] - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    width = max(1, 4_000_000 // len(sets))
    for start in range(0, int(item[-1]) + 1 if len(item) else 0, width):
        a, b = np.searchsorted(item, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], item[a:b] - start] = 1
        both += part @ part.T
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    near &= (block[:, None] == x) & (block[None, :] == y) & (component[:, None] != component[None, :])
    i, j = np.nonzero(near)
    edge = np.arange(len(sets))
    while len(i):
        before = edge.copy()
        np.minimum.at(edge, i, edge[j])
        np.minimum.at(edge, j, edge[i])
        edge = edge[edge]
        if (edge == before).all():
            break
    moved = np.flatnonzero(edge != np.arange(len(edge)))
    return rep[moved], rep[edge[moved]]


def _few_links(data: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as (rep, rep) for a block pair of a few rows, pair by pair: each pair in its first bucket."""
    rep, component, block = (data[c].to_numpy() for c in ("rep", "component", "block"))
    x, y, band = (data[c][0].as_py() for c in ("x", "y", "band"))
    sets = [np.frombuffer(v, np.uint64) for v in data["items"].to_pylist()]
    earlier = [{(b["band"], b["hash"]) for b in row if b["band"] < band} for row in data["buckets"].to_pylist()]
    links = []
    for i, j in combinations(range(len(rep)), 2):
        if component[i] == component[j] or {block[i], block[j]} != {x, y}:
            continue
        few, many = sorted((len(sets[i]), len(sets[j])))
        if 100 * few < percent * many or earlier[i] & earlier[j]:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (few + many - both):
            links.append((rep[i], rep[j]))
    return tuple(np.array(links, np.int64).reshape(-1, 2).T)


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each block pair; rows come sorted by it."""
    held = None
    for batch in chain(batches, (None,)):  # each batch is taken when the one before is done
        if batch is not None:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if held is None:
            return
        keys = [held[c].to_numpy() for c in _BLOCKS]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *change.tolist(), *([held.num_rows] if batch is None else [])]
        made = [(_few_links if b - a <= FEW else _block_links)(held.slice(a, b - a), percent) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        held = held.slice(cuts[-1])
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*made)], names=["a", "b"])


def _compare_buckets(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components inside the open buckets (band, hash, rep, component)."""
    counts = open_.groupBy(*_BUCKET, "component").agg(F.count(F.lit(1)).alias("n"))
    # The main component's rows meet only those of others; these also meet each other.
    plan = save(
        counts.groupBy(*_BUCKET)
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
        .select(*_BUCKET, F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("minor"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("major"))
    )
    placed = (
        open_.join(small(plan), _BUCKET)
        .withColumn("block", F.expr("cast(if(component = main, minor + pmod(xxhash64(rep), major), pmod(xxhash64(rep), minor)) as int)"))
        .withColumn("with", F.explode(F.expr("if(component = main, sequence(0, minor - 1), sequence(0, minor + major - 1))")))
        .select(*_BUCKET, F.expr("cast(least(block, with) as int) as x"), F.expr("cast(greatest(block, with) as int) as y"), "block", "rep", "component")
        .join(open_.groupBy("rep").agg(F.collect_set(F.struct(*_BUCKET)).alias("buckets")), "rep")  # a few for each band
        .join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    )
    return placed.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS).mapInArrow(lambda b: _compared(b, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    width: words of a shingle; percent: least Jaccard similarity of linked documents.  Null or
    wordless texts have no shingles and link with nothing.  Rows that share a doc_id count as one
    document, whose links are those of all its rows.  A null doc_id is never linked, gets a null
    component and is kept.  Further columns of docs are ignored.
    """
    texts = text_bytes(docs)
    signed = save(
        texts.mapInArrow(lambda b: _signed(b, width), "doc_id long, n_shingles long, print binary, bands array<long>")
    )
    named = signed.where("doc_id is not null and print is not null")
    classes = save(named.groupBy("print", "bands").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")))
    banded = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = save(banded.groupBy(*_BUCKET).agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select(*_BUCKET))
    members = save(banded.join(small(shared), _BUCKET).distinct())

    wanted = small(save(members.select(F.col("rep").alias("doc_id")).distinct()))
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda b: _sets(b, width), "doc_id long, items binary")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.distinct()  # rows that repeat an id and its text
    sets = save(sets)
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")

    def confirm(pairs: DataFrame) -> DataFrame:
        return save(
            pairs.distinct()
            .join(left, "a")
            .join(right, "b")
            .select("a", "b", "a_items", "b_items")
            .mapInArrow(lambda b: _confirmed(b, percent), "a long, b long")
        )

    found = None
    state = members.withColumn("component", F.col("rep"))
    for masks in (*_MASKS, None):
        groups = save(state.groupBy(*_BUCKET).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*_BUCKET))
        open_ = save(state.join(small(groups), _BUCKET))
        if open_.limit(1).count() == 0:
            break
        if masks is None:
            new = save(_compare_buckets(open_, sets, percent))
        else:
            heads = save(
                open_.groupBy(*_BUCKET).agg(*(F.min(F.col("rep").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"h{i}") for i, m in enumerate(masks)))
            )
            head = F.explode(F.array_distinct(F.array(*(f"h{i}" for i in range(len(masks)))))).alias("head")
            pairs = open_.join(small(heads), _BUCKET).select("rep", head).where("rep <> head")
            new = confirm(pairs.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")))
        found = new if found is None else found.unionByName(new)
        if masks is None or new.limit(1).count() == 0:
            continue
        tree = components(found)
        state = members.join(tree, members["rep"] == tree["node"], "left").select(
            "rep", "band", "hash", F.coalesce("component", "rep").alias("component")
        )
    # Copies of one set follow its least id; ids with several texts tie their classes together.
    links = named.join(classes.where("rep <> most").select("print", "rep"), "print").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    if found is None:
        tree = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
        several = named.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y")
        if several.limit(1).count():
            tree = components(links)
    else:
        tree = components(links.unionByName(found))
    tree = save(tree)
    # An id that stands in several rows meets its component once for each of them.
    return (
        signed.select("doc_id", "n_shingles")
        .join(small(tree), F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
