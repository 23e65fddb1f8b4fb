"""Tables that grow by numbered batches, each there for all of its tables or for none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchStore:
    """Tables under one folder of a shared file system, written batch by batch.

    A batch's rows of each table are a folder of their own, named by the table and the batch's number.  A
    batch counts once its mark is written, after all of its tables; until then readers do not see it.
    Writing a part of an unmarked batch again replaces what a lost run has left, so a batch that is worked
    off twice is there once.  Folders hold what one writer at a time makes; readers may come at any time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        """(file system, path) of a file or folder of this store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """The numbers of the batches that are there."""
        fs, folder = self._file("marks")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def has(self, number: int) -> bool:
        fs, mark = self._file(f"marks/{number}")
        return fs.exists(mark)

    def next_number(self) -> int:
        return max(self.numbers(), default=-1) + 1

    def put(self, number: int, table: str, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Write a batch's rows of a table, in folders by the columns of by, and read them back."""
        rows.write.mode("overwrite").partitionBy(*by).parquet(self._folder(table, number))
        return self._read(table, [number], rows)

    def commit(self, number: int) -> None:
        """Let a batch count: one empty file, which is there or not."""
        fs, mark = self._file(f"marks/{number}")
        fs.create(mark, True).close()

    def drop(self, number: int, table: str) -> None:
        """Delete a batch's rows of a table that was only needed to make the others."""
        fs, folder = self._file(f"{table}/batch={number}")
        fs.delete(folder, True)

    def read(self, table: str, like: DataFrame | str) -> DataFrame:
        """All rows of a table, with batch; like has its columns (a frame, or a schema as text)."""
        return self._read(table, self.numbers(), like)

    def _folder(self, table: str, number: int) -> str:
        return f"{self.path}/{table}/batch={number}"

    def _read(self, table: str, numbers: Sequence[int], like: DataFrame | str) -> DataFrame:
        schema = like if isinstance(like, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        reader = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{table}")
        return reader.parquet(*(self._folder(table, n) for n in numbers))


def latest_batch(rows: DataFrame) -> DataFrame:
    """The rows of the last batch of a table."""
    last = rows.agg(F.max("batch").alias("_last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("_last")  # one row
