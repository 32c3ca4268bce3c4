"""Stored flights: folders read, rejected rows, total order, one scan for several results."""

import os

import pytest
from pyspark.sql import functions as F

from tarmac.operators import delays
from tarmac.plans import harness, sinks, study
from tarmac.sources import flights as ft

FLIGHTS = [("AA", y, m, 0.0, 0.0, 100 * h, float(h), 1.0, *[None] * 5) for y in (2023, 2024, 2025) for m in range(1, 13) for h in range(5)]


@pytest.fixture
def stored(spark, tmp_path):
    ft.store_flights(spark.createDataFrame(FLIGHTS, ft.SCHEMA).repartition(4), str(tmp_path / "t"))
    return str(tmp_path / "t")


def files_read(df):
    """The plan of a query, and how many folders its scans have read."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "FileSourceScanExec" and node.metrics().contains("numPartitions"):
            found.append(node.metrics().apply("numPartitions").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return plan.toString(), found


def test_years_prune_folders_when_planned(spark, stored):
    plan, found = files_read(ft.flights_of(spark, stored, years=(2024,)).select("DEP_DELAY"))
    assert "YEAR" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert found == [12]
    assert ft.flights_of(spark, stored, years=(2024,)).count() == 60


def test_months_of_a_table_prune_folders_when_it_runs(spark, stored, tmp_path):
    months = spark.createDataFrame([(y, m, (m + 2) // 3) for y in (2023, 2024, 2025) for m in range(1, 13)], "YEAR int, MONTH int, quarter int")
    months.write.parquet(str(tmp_path / "months"))
    wanted = spark.read.parquet(str(tmp_path / "months")).where("quarter = 1")
    plan, found = files_read(ft.flights_of(spark, stored, months=wanted).select("DEP_DELAY"))
    assert "dynamicpruning" in plan
    assert found == [9]
    got = ft.flights_of(spark, stored, (2025,), wanted)
    assert got.columns == [f.name for f in ft.SCHEMA] and got.count() == 15


def test_a_month_is_few_files(stored):
    assert len(os.listdir(f"{stored}/YEAR=2024")) == 12
    assert sum(n.endswith(".parquet") for n in os.listdir(f"{stored}/YEAR=2024/MONTH=5")) == 1


def test_rejected_rows_have_reasons(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    (source / "a.csv").write_text("YEAR,MONTH,OP_UNIQUE_CARRIER,CANCELLED,DEP_DELAY,CRS_DEP_TIME\n2025,1,AA,0.00,-3.0,900\n2025,May,DL,x,,10\n2025,3,UA,,,\n")
    (source / "b.csv").write_text("YEAR,MONTH,OP_UNIQUE_CARRIER,CANCELLED,DEP_DELAY,CRS_DEP_TIME\n2025,1,WN,1.00,soon,12:30\n")
    ft.ingest_checked(spark, str(source), str(tmp_path / "t"))
    good = {r["OP_UNIQUE_CARRIER"]: r for r in ft.accepted(spark, str(tmp_path / "t")).collect()}
    assert good.keys() == {"AA", "UA"} and good["AA"]["DEP_DELAY"] == -3.0 and good["UA"]["CANCELLED"] is None and good["AA"]["ARR_DELAY"] is None
    bad = {r["OP_UNIQUE_CARRIER"]: r for r in ft.rejected(spark, str(tmp_path / "t")).collect()}
    assert {k: {(x["column"], x["value"]) for x in r["reasons"]} for k, r in bad.items()} == {"DL": {("MONTH", "May"), ("CANCELLED", "x")}, "WN": {("DEP_DELAY", "soon"), ("CRS_DEP_TIME", "12:30")}}
    assert (bad["DL"]["file"], bad["DL"]["row"]) == ("a.csv", 1) and (bad["WN"]["file"], bad["WN"]["row"]) == ("b.csv", 0)
    assert bad["DL"]["YEAR"] == 2025 and bad["DL"]["MONTH"] is None


def test_all_rows_accepted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,MONTH,OP_UNIQUE_CARRIER\n2025,1,AA\n")
    ft.ingest_checked(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"))
    assert ft.accepted(spark, str(tmp_path / "t")).count() == 1 and ft.rejected(spark, str(tmp_path / "t")).count() == 0


def test_ordered_files_follow_each_other(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b")).repartition(5)
    sinks.save_ordered(df, str(tmp_path / "o"), ["a", "b"], 6)
    names = sorted(n for n in os.listdir(tmp_path / "o") if n.endswith(".parquet"))
    assert 4 <= len(names) <= 6
    rows = [[tuple(r) for r in spark.read.parquet(str(tmp_path / "o" / n)).collect()] for n in names]
    flat = [r for part in rows for r in part]
    assert flat == sorted(flat) and len(flat) == 5000 and max(map(len, rows)) < 2500


def test_ordered_ranges_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ORDERED_ROWS", 500)
    for n in (2000, 8000):
        where = tmp_path / str(n)
        sinks.save_ordered(spark.range(n).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b")), str(where), ["a", "b"], 2)
        rows = [[tuple(r) for r in spark.read.parquet(str(where / x)).collect()] for x in sorted(os.listdir(where)) if x.endswith(".parquet")]
        flat = [r for part in rows for r in part]
        assert flat == sorted(flat) and len(flat) == n and max(map(len, rows)) < 1000


def test_one_scan_gives_all_results(spark, stored):
    rows = delays.flown_by_hour(ft.load_flights(spark, stored))
    with harness.one_scan(rows, rows=F.count("*"), worst=F.max("DEP_DELAY")) as (kept, seen):
        first, second = kept.groupBy("hour").count(), kept.agg(F.max("DEP_DELAY"))
        assert first.count() == 5 and second.first()[0] == 4.0 and seen.get == {"rows": 180, "worst": 4.0}
        for q in (first, second):
            assert "InMemoryTableScan" in q._jdf.queryExecution().executedPlan().toString()
        assert kept.storageLevel.useMemory
    assert not kept.storageLevel.useMemory
    with pytest.raises(ZeroDivisionError), harness.one_scan(rows) as (kept, _):
        1 / 0
    assert not kept.storageLevel.useMemory


def test_deltas_of_studies(spark):
    schema = "study string, label string, n_features int, features string, best_k int, best_silhouette double, best_wssse double, elapsed_seconds double"
    rows = [("extended", "E", 10, "", 3, 0.5, 90.0, 1.0), ("base", "B", 8, "", 2, 0.6, 70.5, 2.0)]
    assert [tuple(r) for r in study.deltas(spark.createDataFrame(rows, schema)).collect()] == [("extended", "base", 2, 1, -0.1, 19.5)]


def test_profile_does_not_depend_on_the_order_of_rows(spark):
    """Distances that lie halfway, as 0.1 + 0.2 + 0.3: both orders of the rows round to the same digit, away from 0."""
    values = [("a", 0.1), ("b", 0.2), ("c", 0.30015), ("d", 0.0), ("e", 0.0), ("f", 0.0)]
    found = []
    for rows in (values, values[::-1], values[3:] + [values[2], values[1], values[0]]):
        table = spark.createDataFrame(rows, "OP_UNIQUE_CARRIER string, x double").coalesce(1)
        own = table.withColumn("prediction", F.col("OP_UNIQUE_CARRIER").isin("d", "e", "f").cast("int"))
        found.append([(r["x_mean"], r["x_delta"]) for r in study.profile(own, table, ["x"]).collect()])
    assert found == [[(0.2001, 0.1), (0.0, -0.1)]] * 3
    rows = [(f"c{i}", v) for i, v in enumerate([1.1, 1.1003, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "OP_UNIQUE_CARRIER string, x double").coalesce(1)
    out = study.profile(table.withColumn("prediction", F.lit(0)).where("x > 0"), table, ["x"]).collect()
    assert [(r["x_mean"], r["x_delta"]) for r in out] == [(1.1002, 0.5501)]
