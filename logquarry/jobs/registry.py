"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logquarry.jobs.query import SQL, QUERIES  # noqa: F401  (filled by the imports below)
from logquarry.jobs import alerting, detection, health, ingest, parsing, pseudonyms, rules, scoring, streams  # noqa: F401, E402

Query = Callable[[SparkSession, str], DataFrame]
