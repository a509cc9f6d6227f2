"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from quillgrove.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return held


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x
    return sorted([tuple(value(r[k]) for k in order) for r in found], key=repr)


@pytest.mark.parametrize("name", catalog.SQL)
def test_query(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    expected = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(columns, expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
