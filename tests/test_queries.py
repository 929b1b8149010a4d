"""Every product query with SQL against DuckDB on the smallest tables; every other one must run. Needs the test tables."""

from __future__ import annotations

import math
import os

import pytest

from skuforge.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SLOW = {"c04_best_in_dictionary", "i06_stage_trace", "g02_trained_type", "g03_trained_third_tag"}


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    c = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    pick = lambda rows, names: sorted((tuple(norm(r[names.index(k)]) for k in order) for r in rows), key=repr)
    assert pick(got, df.columns) == pick(c.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
