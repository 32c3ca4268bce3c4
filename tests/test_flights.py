"""Nulls, empty groups and ties, on rows made by hand."""

import math

import numpy as np
import pytest

from tarmac.functions.expressions import BASE, EXTRA
from tarmac.functions.sketches import compress, digest_quantile
from tarmac.operators import carriers, delays
from tarmac.plans import serving, sinks, study
from tarmac.plans.harness import summary, timed
from tarmac.sources import files
from tarmac.sources.flights import SCHEMA, checked, ingest_csv, load_flights


def row(carrier="AA", month=1, cancelled=0.0, diverted=0.0, at=900, dep=None, arr=None, causes=(None,) * 5, year=2025):
    return (carrier, year, month, cancelled, diverted, at, dep, arr, *causes)


@pytest.fixture
def flights(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_null_cancelled_counts_without_its_delay(flights):
    r = one(delays.monthly_stats(flights([row(dep=10.0), row(cancelled=None, dep=99.0)])))
    assert (r["total_flights"], r["cancelled_flights"], r["avg_dep_delay"], r["max_dep_delay"]) == (2, 0, 10.0, 10.0)


def test_all_cancelled(flights):
    f = flights([row(cancelled=1.0), row(cancelled=1.0)])
    r = one(delays.monthly_stats(f))
    assert r["cancellation_rate_pct"] == 100.0 and r["avg_dep_delay"] is None
    assert one(carriers.carrier_features(f, [*BASE, *EXTRA]))["on_time_rate"] is None


def test_flown_without_delay_is_in_the_on_time_denominator(flights):
    r = one(carriers.carrier_features(flights([row(dep=-1.0), row(dep=None)]), ["on_time_rate", "avg_dep_delay"]))
    assert r["on_time_rate"] == 50.0 and r["avg_dep_delay"] == -1.0


def test_null_causes_are_zero(flights):
    f = flights([row(arr=20.0, causes=(8.0, None, None, None, None)), row(arr=10.0)])
    r = one(delays.top_delays(f, least=1))
    assert r["avg_carrier_delay"] == 4.0 and r["avg_nas_delay"] == 0.0 and r["avg_arr_delay"] == 15.0


def test_diverted_flights_count_in_features_but_not_in_top_delays(flights):
    f = flights([row(arr=20.0, causes=(8.0,) * 5), row(diverted=1.0)])
    assert one(delays.top_delays(f, least=1))["avg_carrier_delay"] == 8.0
    assert one(carriers.carrier_features(f, ["avg_carrier_delay"]))["avg_carrier_delay"] == 4.0


def test_having_and_ties(flights):
    rows = [row("AA", arr=1.0)] * 499 + [row("DL", arr=1.0)] * 500 + [row("UA", arr=1.0)] * 500
    assert [r[0] for r in delays.top_delays(flights(rows)).collect()] == ["DL", "UA"]
    assert [r[0] for r in carriers.top_carriers(flights(rows), 1).collect()] == ["DL"]


def test_hours(flights):
    f = flights([row(at=t, dep=1.0) for t in (None, 5, 2359, 2400)])
    assert [r["hour"] for r in delays.percentiles_approx(f).collect()] == [None, 0, 23, 24]


@pytest.mark.parametrize(("values", "want"), [([4.0], (4.0,) * 4), ([0.0, 10.0], (2.5, 5.0, 7.5, 9.0)), (list(map(float, range(10))), (2.25, 4.5, 6.75, 8.1))])
def test_exact_percentiles(flights, values, want):
    r = one(delays.percentiles_exact(flights([row(dep=v) for v in values])))
    assert tuple(r[p] for p in delays.RANKS) == want


def test_groups_of_nulls(flights):
    f = flights([row(dep=None), row(dep=None)])
    assert one(delays.percentiles_approx(f))["p50"] is None
    for q in (delays.percentiles_exact, delays.percentiles_kll, delays.percentiles_tdigest):
        assert q(f).count() == 0
    assert one(delays.delay_range(f))["min_delay"] is None


def test_sketches_keep_their_rank_error(spark, flights):
    values = [float((i * 7919) % 10007) for i in range(10007)]
    f = flights([row(dep=v) for v in values])
    for q, eps in ((delays.percentiles_kll, 0.03), (delays.percentiles_tdigest, 0.01)):
        r = one(q(f))
        for p, rank in delays.RANKS.items():
            assert abs(r[p] / 10007 - rank) < eps
    assert one(delays.percentiles_kll(flights([row(dep=1.0)])))["p90"] == 1.0


def test_digest_merges_like_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000)
    parts = [compress(p, np.ones(len(p))) for p in np.array_split(x, 7)]
    m, w = compress(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert w.sum() == 20000 and len(m) < 400
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        assert abs((x < digest_quantile(m, w, q)).mean() - q) < 0.01
    assert digest_quantile([], [], 0.5) is None


def test_empty_table(flights):
    f = flights([])
    for q in (delays.monthly_stats, delays.top_delays, delays.percentiles_approx, delays.percentiles_tdigest, delays.delay_rollup, carriers.top_carriers, carriers.flights_of_top_carriers):
        assert q(f).count() == 0


@pytest.fixture
def table(spark):
    rows = [("AA", 1, 1.0, 2.0, 5.0, None), ("DL", 2, 2.0, 4.1, 5.0, 1.0), ("UA", 3, 3.0, 5.9, 5.0, 0.0), ("WN", 4, 9.0, 18.0, 5.0, 4.0)]
    return spark.createDataFrame(rows, "OP_UNIQUE_CARRIER string, total_flights long, a double, b double, c double, d double")


def test_correlation_and_redundancy(table):
    found = {(r["extra_feature"], r["feature"]): r["raw"] for r in carriers.feature_correlation(table, list("abcd"), ["b", "c", "d"]).collect()}
    x = {k: np.nan_to_num([r[k] if r[k] is not None else math.nan for r in table.collect()]) for k in "abcd"}
    assert found["c", "a"] == 0.0
    assert found["b", "a"] == pytest.approx(np.corrcoef(x["a"], x["b"])[0, 1])
    assert found["d", "b"] == pytest.approx(np.corrcoef(x["d"], x["b"])[0, 1])
    verdicts = {r["extra_feature"]: r["verdict"] for r in carriers.feature_redundancy(table, list("abcd"), ["b", "c", "d"]).collect()}
    assert verdicts["b"] == "REDUNDANT" and verdicts["c"] == "KEEP"
    report = {r["extra_feature"]: r for r in carriers.correlation_report(table, list("abcd"), ["b", "c"]).collect()}
    assert report["b"]["corr_b"] == 1.0 and report["c"]["corr_a"] == 0.0


def test_constant_features_score_zero(table):
    scores = [r["zscore"] for r in carriers.zscores(table, ["a", "c"]).where("feature = 'c'").collect()]
    assert scores == [0.0] * 4


def test_study_is_consistent_with_its_labels(table):
    scaled = study.standardised(table, list("abc"))
    s = study.sweep(scaled, range(2, 7))
    assert sorted(s.models) == [2, 3, 4]
    again = study.sweep(study.standardised(table, list("abc")), range(2, 7))
    assert s.wssse == again.wssse and s.best_k == again.best_k
    assigned = s.models[2].transform(scaled)
    rows = [(r["prediction"], np.array(r["features"])) for r in assigned.collect()]
    wssse = sum(((x - np.mean([y for q, y in rows if q == p], axis=0)) ** 2).sum() for p, x in rows)
    assert wssse == pytest.approx(s.wssse[2])
    found = study.profile(assigned, table, list("abc")).collect()
    means = [r["a_mean"] * r["n_carriers"] for r in found]
    assert sum(means) == pytest.approx(15.0, abs=1e-3)
    assert all(r["c_zscore"] == 0.0 for r in found)


def test_run_study(spark, flights):
    rows = [row(c, dep=float(i * j % 7), arr=float(i + j), causes=(float(j),) * 5) for i, c in enumerate(["AA", "DL", "UA", "WN", "B6", "OO"]) for j in range(9)]
    studies = [study.run_study(flights(rows), n) for n in ("base", "extended")]
    assert set(study.BASE) <= set(studies[1].features)
    assert studies[0].pca().count() == 6 and studies[0].assignments().columns[-1] == "prediction"
    assert study.comparison(studies).count() == 2


def test_serving(spark, flights):
    q1 = delays.monthly_stats(flights([row(dep=10.0), row(month=2, cancelled=1.0)]))
    rows = serving.q1_hash(q1)
    assert {r["field"]: r["value"] for r in serving.hash_of(rows, "q1:AA:2025:2").collect()}["avg_dep_delay"] == ""
    assert serving.as_maps(rows).count() == 2
    viz = {(r["key"], r["field"]): r["value"] for r in serving.q1_viz(q1).collect()}
    assert viz["q1:viz:AA:avg_dep_delay", "Jan"] == "10.0"
    ranking = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 3.0), ("k", "c", None), ("k", "d", 3.0)], "key string, member string, score double")
    assert [r["member"] for r in serving.top(ranking).collect()] == ["b", "d", "a"]


def test_publish(spark, tmp_path):
    log = str(tmp_path / "log")

    class Client:
        def hset(self, key, field, value):
            with open(log, "a") as f:
                f.write(f"{key} {field} {value}\n")

    serving.publish(spark.createDataFrame([("k", "f", "v")], "key string, field string, value string"), Client)
    assert open(log).read() == "k f v\n"


def test_files(spark, tmp_path, flights):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("a,b", None), ("c", 2)], "x string, y int")
    sinks.save_csv(df, path)
    assert sorted(map(tuple, files.read_csv_text(spark, path).collect())) == [("a,b", ""), ("c", "2")]
    assert files.read_csv_named(spark, path, ["x", "y"]).count() == 2
    assert files.exists(spark, path) and not files.exists(spark, path + "no")
    assert files.read_optional(spark, path + "no", ["x"]).count() == 0
    local = str(tmp_path / "l.csv")
    sinks.save_result_local(local, df)
    assert open(local).read().splitlines() == ["x,y", '"a,b",', "c,2"]
    assert sinks.table(df.where("false")) == "no result" and "a,b" in sinks.table(df)


def test_ingest_and_schema(spark, tmp_path, flights):
    source, target = tmp_path / "raw.csv", str(tmp_path / "table")
    source.write_text("YEAR,MONTH,OP_UNIQUE_CARRIER,CANCELLED,DEP_DELAY\n2025,1,AA,0.00,-3.0\n2025,2,DL,x,\n")
    ingest_csv(spark, str(source), target)
    got = {r["OP_UNIQUE_CARRIER"]: r for r in load_flights(spark, target).collect()}
    assert got["AA"]["DEP_DELAY"] == -3.0 and got["DL"]["CANCELLED"] is None and got["DL"]["MONTH"] == 2
    with pytest.raises(ValueError, match="lacks"):
        checked(spark.createDataFrame([(1,)], "YEAR int"))


def test_harness(spark):
    assert len(timed(lambda: spark.range(3), 2)) == 2
    r = one(summary(spark, [("q1", "df", 1, 2.0)]))
    assert r["variance"] == 0.0 and r["median"] == 2.0
    assert one(summary(spark, [("q1", "df", i, x) for i, x in enumerate([1.0, 2.0, 6.0])]))["variance"] == 7.0


def test_entry(spark):
    import os

    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
