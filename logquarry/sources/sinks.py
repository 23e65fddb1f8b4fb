"""Writers of events, quarantine, results and notification rows."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("informational", "low", "medium", "high", "critical")


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """When the driver ends, its scratch folders go."""
    for spark, path in _scratch:
        with contextlib.suppress(Exception):  # the engine may have ended first
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, or in the warehouse where there is none.

    On a cluster a warehouse on local disks is refused: each executor would write to its own.  What is
    written there goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df from a new table in the shared folder, in folders by the columns of by: its lineage ends there.

    Shuffle files of the finished query are dropped where Spark can do so: the table replaces them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def removable(df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[DataFrame, Callable[..., DataFrame | None]]:
    """Like written(), with what deletes the table as soon as nothing reads it any more; of a folder's name, it
    deletes that folder and returns the rest."""
    out = written(df, name, by)
    spark, path = _scratch[-1]

    def remove(part: str = "") -> DataFrame | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if part:
            return spark.read.schema(df.schema).parquet(path)
        _scratch.remove((spark, path))

    return out, remove


def write_by_date(rows: DataFrame, path: str, at: str = "received_at") -> None:
    """Append rows as Parquet, partitioned by the UTC date of a timestamp."""
    day = F.date_format(F.to_utc_timestamp(F.col(at), F.current_timezone()), "yyyy-MM-dd")
    rows.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows as JSON lines."""
    rows.write.mode("append").json(path)


def level_rank(level: Column) -> Column:
    """0 for the lowest level; unknown levels rank lowest."""
    out = F.lit(0)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def alert_outbox(alerts: DataFrame, fmt: str = "json", base_url: str = "", min_level: str = "low", enabled: bool = True) -> DataFrame:
    """alert_id, notified, body for alerts (alert_id, kind, title, level, count, notified) not yet notified.

    notified becomes 1 with a body to deliver, or 2 without one where the level is below min_level or
    nothing is to be delivered.  Bodies hold id, title, level, count, kind and link only.
    """
    link = F.concat(F.lit(base_url.rstrip("/") + "/alerts/"), F.col("alert_id").cast("string")) if base_url else F.lit("")
    text = F.format_string("[%s] %s (%d x %s)", F.upper("level"), F.col("title"), F.col("count").cast("long"), F.col("kind"))
    full = F.concat(text, F.when(F.length(link) > 0, F.concat(F.lit("\n"), link)).otherwise(F.lit("")))
    payloads = {
        "json": F.to_json(F.struct(F.col("alert_id").alias("id"), "title", "level", "count", "kind", link.alias("link"))),
        "ntfy": full,
        "discord": F.to_json(F.struct(full.alias("content"))),
        "slack": F.to_json(F.struct(full.alias("text"))),
    }
    quiet = (level_rank(F.col("level")) < LEVELS.index(min_level)) | F.lit(not enabled)
    return alerts.where("notified = 0").select(
        "alert_id", F.when(quiet, 2).otherwise(1).alias("notified"), F.when(~quiet, payloads[fmt]).alias("body")
    )
