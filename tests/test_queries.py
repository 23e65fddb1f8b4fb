"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from logquarry.jobs import registry

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float):
            return round(x, 6)
        return bool(x) if type(x).__name__ in ("bool", "bool_") else x if isinstance(x, str) else int(x)

    columns = sorted(frame.columns)
    return columns, sorted(([plain(x) for x in r] for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    if name in registry.SQL:
        assert rows(got) == rows(duck.sql(registry.SQL[name]).df())
    else:
        assert len(got)
