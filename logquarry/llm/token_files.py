"""Token ids of a corpus in ORC files: ascending ids, row indexes and Bloom filters on doc_id.

ORC stores integer columns in stripes, run-length encoded, with least and greatest values per stripe
and per row group.  Files and stripes are independent, so readers share a corpus by stripes, and a
look-up by doc_id reads only row groups whose range and Bloom filter admit it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.tables import save, saved, shared_dir, small, text_bytes
from logquarry.llm.tokens import as_texts, encoder, slices

OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch):
            lists = encoder(path).lists(as_texts(part.column(1)), end_id)
            cuts = lists.offsets.to_numpy().astype(np.int64)
            starts = at + cuts[:-1]
            at += int(cuts[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(len(starts), shard, np.int32)), pa.array(starts), lists],
                names=["doc_id", "shard", "place", "ids"],
            )


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every text of docs (doc_id, text), add end_id and write ORC files in ascending doc_id order.

    Files hold doc_id, shard (the file's number), place (ids before the document in its shard) and ids.
    Null texts are empty, null doc_ids come first, rows that share a doc_id follow the order of
    their texts.  Texts are dealt by ranges of doc_id before they are encoded: each is encoded once.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    text_bytes(ordered).mapInArrow(
        lambda b: _encoded(b, tokenizer_path, end_id), "doc_id long, shard int, place long, ids array<int>"
    ).write.options(**OPTIONS).orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, int)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, shard, place, ids.  Filters on doc_id reach row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, shard int, place long, ids array<int>").orc(path)


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of what read_token_files() gives.

    The files' own totals, one row a file, give where each file begins.  Null and repeated doc_ids keep
    their rows; an empty set of files gives no rows.
    """
    rows = save(files.mapInArrow(_digests, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = save(totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    return rows.join(small(bases), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as token files in the shared folder and return the digests read from them: one row for
    each row of docs, whatever is null, empty or repeated (see write_token_files)."""
    path = f"{shared_dir(docs.sparkSession)}/logquarry-ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_digests(saved(read_token_files(docs.sparkSession, path), path))
