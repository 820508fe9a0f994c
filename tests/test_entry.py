from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from siftlode.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([cell(x) for x in list(v)])
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{float(v):.9g}" if not isinstance(v, (str, bytes)) else v

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(oracles.ORACLE_SQL[name]).df())


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
