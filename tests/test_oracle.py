"""Every query with an oracle equals DuckDB's result on the driver's tables; the others give rows."""

import os

import duckdb
import pytest

from tarmac import registry
from tarmac.sources.flights import fixture_flights

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    found = oracle.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_names():
    assert set(registry.ORACLES) <= set(registry.queries())


def test_plans_push_and_prune(spark):
    flights = fixture_flights(spark, DATA)
    plan = registry.flight_queries()["q2_top_delay"](flights)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
