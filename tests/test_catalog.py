"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import math
from pathlib import Path

import pytest

from tabulon.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    result = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count()


def test_roman_numbers_come_back(spark):
    rows = catalog.roman_alpha(spark, FOLDER).collect()
    assert all(r.back == r.p_partkey % 3999 + 1 for r in rows)
    assert {r.p_partkey: r.roman for r in rows}[3] == "IV"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark):
    plan = catalog.subtotal_one(spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1]
