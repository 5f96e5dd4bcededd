"""Every query with SQL equals DuckDB's answer on the smallest tables; every other one runs with a stable schema."""

import os

import duckdb
import pytest

from pointweave.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else None
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return [normal(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([normal(v) for v in r]) for r in df.select(*columns).collect())
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(repr([normal(v) for v in r]) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
