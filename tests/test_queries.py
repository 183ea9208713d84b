"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows and a stable schema."""

import math
import os

import duckdb
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return value.isoformat().replace(" ", "T")[:19] if hasattr(value, "isoformat") else str(value)


def rows(found):
    return sorted(tuple(plain(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names).collect()) == rows(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.schema == catalog.QUERIES[name](spark, SF).schema
    assert rows(df.collect()) == rows(catalog.QUERIES[name](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_of_all_pairs(spark):
    found = catalog.QUERIES["block_bootstrap"](spark, SF).collect()
    assert len({(r.a, r.b) for r in found}) == len(found) == 10
    assert all(1900 <= r.draws <= 2000 and -1 <= r.bound <= 1 + 1e-9 for r in found)
