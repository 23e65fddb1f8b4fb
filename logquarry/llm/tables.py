"""Intermediate tables in the shared folder, and joins that broadcast only what has been counted."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of (compressed) files up to which a saved table is broadcast; beyond them the join shuffles.
#: Files grow some tenfold in memory, lists most of all, so a broadcast stays well below 100 MB.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 8 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: list[tempfile.TemporaryDirectory] = []
_tables: list[DataFrame] = []


@atexit.register
def _leave() -> None:
    """When the driver ends, its tables go: frames that read them end with it."""
    with contextlib.suppress(Exception):  # the engine may have ended first
        drop(*_tables)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of setCheckpointDir(); a local temporary one where a
    local session has none (tests).  On a cluster without either it raises, as executors would write
    to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append(tempfile.TemporaryDirectory(prefix="logquarry-"))
            atexit.register(_fallback[0].cleanup)
        path = "file://" + _fallback[0].name
    return path.rstrip("/")


def save(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there.

    Shuffle files of the finished query are dropped where Spark can do so: the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logquarry-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.format(fmt).save(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return saved(spark.read.format(fmt).schema(df.schema).load(path), path)


def saved(df: DataFrame, path: str) -> DataFrame:
    """df, which reads the files at path: they can be dropped, and go when the driver ends."""
    df.saved_at = path
    _tables.append(df)
    return df


def _files(df: DataFrame):
    """(file system, path) of a table made by save()."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


def drop(*frames: DataFrame) -> None:
    """Delete tables made by save() that nothing reads any more."""
    for df in frames:
        fs, path = _files(df)
        fs.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A table made by save(), marked for broadcast if it is small enough; as it is otherwise."""
    fs, path = _files(df)
    fits = fs.getContentSummary(path).getLength() <= size and df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if fits else df


def text_bytes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id long, text binary, carried): whole texts as UTF-8, for functions on Arrow batches.

    carried is a struct of the columns named by carry, absent if there are none.  Texts can be long, so
    batches are held to a thousand rows and 16 MB where the session has Spark's defaults.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def with_carried(schema: str, docs: DataFrame, carry: Sequence[str]) -> str:
    """schema, and the struct that text_bytes() makes of the columns named by carry."""
    return f"{schema}, carried {docs.select(F.struct(*carry)).schema[0].dataType.simpleString()}" if carry else schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
