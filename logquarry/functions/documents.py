"""Nested JSON documents as (dotted path, value) leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def flatten(doc: object, path: str = "") -> Iterator[tuple[str, object]]:
    """The leaves of a document; members of lists share their list's path."""
    if isinstance(doc, dict):
        for key, value in doc.items():
            yield from flatten(value, f"{path}.{key}" if path else key)
    elif isinstance(doc, list):
        for value in doc:
            yield from flatten(value, path)
    else:
        yield path, doc


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def _leaves(docs: pd.Series) -> pd.Series:
    def of(text):
        try:
            doc = json.loads(text) if text else {}
        except ValueError:
            return []
        return [{"path": p, "value": v if isinstance(v, str) else json.dumps(v)} for p, v in flatten(doc) if v is not None]

    return docs.map(of)


def leaves(docs: DataFrame, column: str) -> DataFrame:
    """The other columns with path and value of each leaf of a JSON column; nulls, broken and empty
    documents have none.  Values are text: strings as they are, others as JSON."""
    rest = [c for c in docs.columns if c != column]
    return docs.select(*rest, F.explode(_leaves(column)).alias("_l")).select(*rest, "_l.path", "_l.value")
