"""Every query with SQL against DuckDB over the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from readloom import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_queries_without_sql(spark):
    assert {n for n in catalog.QUERIES if n not in catalog.SQL} == {"dedup_fuse"}
    out = catalog.dedup_fuse(spark, DIR)
    assert out.where("not removed").count() > 0
