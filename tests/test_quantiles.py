"""Exact selection, stored sketches and merged digests, against plain quantiles."""

import numpy as np
import pytest

from tarmac.functions import quantiles, sketches
from tarmac.operators import delays

RANKS = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def plain(values):
    return tuple(float(np.quantile(np.array(values, float), q)) for q in RANKS.values())


@pytest.mark.parametrize("buckets", [16, 1024])
def test_selection_equals_plain_quantiles(spark, buckets):
    rng = np.random.default_rng(0)
    groups = {
        ("hot", 1): rng.integers(-20, 60, 3000).astype(float).tolist(), ("wide", None): (rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)).tolist(),
        (None, 2): [5.0], ("same", 3): [1.5] * 50, ("ends", 4): [-1.7e308, 1.7e308, 0.0, 5e-324, 0.0], ("near", 5): np.nextafter(1.0, np.arange(9) / 4).tolist(),
    }
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", 1, None), ("none", 6, None), ("same", 3, float("nan"))]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(5)
    got = {(r["a"], r["b"]): tuple(r[p] for p in RANKS) for r in quantiles.exact_quantiles(df, ["a", "b"], "v", RANKS, digits=400, buckets=buckets).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(plain(vs), rel=1e-12), k


def test_selection_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "a string, v double"), ["a"], "v", RANKS).count() == 0


def test_no_task_gets_a_group(spark):
    """Rows are joined and counted where they are; what is sorted or windowed are counts."""
    rows = spark.range(10_000).selectExpr("'x' AS k", "CAST(id % 977 AS DOUBLE) AS _v")
    first = spark.createDataFrame([("x", 0.0, 976.0, 0, [5000])], "k string, _lo double, _hi double, _base long, _at array<long>")
    out = quantiles.narrowed(rows, first, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate") and "partial_count" in plan and "SortAggregate" not in plan
    found = out.collect()
    assert len(found) == 1 and found[0]["_lo"] <= sorted(i % 977 for i in range(10_000))[5000] <= found[0]["_hi"]


def test_states_merge_without_rows(spark):
    df = spark.range(40_000).selectExpr("id % 7 AS h", "id % 2 AS c", "CAST(id * 7919 % 10007 AS DOUBLE) AS v").repartition(6)
    states = sketches.kll_states(df, ["c", "h"], "v", 400)
    by_carrier = sketches.kll_merged(states, ["c"])
    for r in sketches.kll_read(by_carrier, ["c"], RANKS).collect():
        for p, q in RANKS.items():
            assert abs(r[p] / 10007 - q) < 0.015
    assert states.select("state").schema[0].dataType.simpleString() == "binary" and by_carrier.count() == 2


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_digest_is_within_its_bound_for_any_number_of_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(sketches, "FAN", 4)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(50, 2_000)])
    df = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "k int, v double").repartition(parts)
    ranks = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    errors = sketches.rank_errors(df, sketches.tdigest_quantiles(df, ["k"], "v", ranks, digits=9), ["k"], "v", ranks).collect()
    assert len(errors) == 8
    for r in errors:
        assert r["rank_error"] < (0.002 if r["percentile"] in ("p01", "p99") else 0.01), r


def test_ordered_results_leave_the_aggregate_spread(spark):
    df = spark.range(1000).selectExpr("CAST(id % 50 AS INT) AS k", "CAST(id AS DOUBLE) AS v")
    out = delays.in_order(df.groupBy("k").agg({"v": "max"}), "k")
    assert [r["k"] for r in out.collect()] == list(range(50))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Coalesce" not in plan and "REPARTITION_BY_NUM" in plan


def test_percentiles_approx_have_exact_ranks_in_large_groups(spark):
    """100,000 different delays in a group: the four values are those of the SQL's quantile_disc, for the DataFrame and the SQL face."""
    from tarmac import registry

    n = 100_000
    flights = spark.range(n).selectExpr("'AA' AS OP_UNIQUE_CARRIER", "0D AS CANCELLED", "630 AS CRS_DEP_TIME", f"CAST(id * 7919 % {n} AS DOUBLE) AS DEP_DELAY")
    for name in ("q3_percentiles_approx", "q3_percentiles_approx_sql"):
        found = registry.flight_queries()[name](flights).collect()
        assert [tuple(r) for r in found] == [("AA", 6, n * 0.25 - 1, n * 0.5 - 1, n * 0.75 - 1, n * 0.9 - 1)]
