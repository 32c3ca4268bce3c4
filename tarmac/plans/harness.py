"""Timed runs of the queries and their statistics.

python -m tarmac.plans.harness --q 1 --api df --runs 20 --input DIR
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = 20


def timed(build: Callable[[], DataFrame], runs: int = RUNS) -> list[float]:
    """Seconds of each run, from building the plan until its rows are here."""
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        build().collect()
        out.append(time.perf_counter() - began)
    return out


def statistics(df: DataFrame) -> DataFrame:
    """min, max, avg, median and sample variance (0 for a single run) of compute_time by query and api."""
    t = F.col("compute_time")
    variance = F.coalesce(F.when(F.count("*") > 1, F.var_samp(t)), F.lit(0.0))
    return df.groupBy("query", "api").agg(F.min(t).alias("min"), F.max(t).alias("max"), F.avg(t).alias("avg"), F.median(t).alias("median"), variance.alias("variance"))


def summary(spark: SparkSession, runs: Sequence[tuple[str, str, int, float]]) -> DataFrame:
    """``statistics`` of (query, api, run, seconds)."""
    return statistics(spark.createDataFrame(list(runs), "query string, api string, run int, compute_time double"))


@contextmanager
def one_scan(df: DataFrame, **counts: Column) -> Iterator[tuple[DataFrame, Observation]]:
    """``df`` kept for several results, and what its one scan observes: the aggregates ``counts``, there once the first result is.

    It is given up at the end, whatever happens in between.
    """
    seen = Observation()
    kept = (df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if counts else df.select("*")).persist()
    try:
        yield kept, seen
    finally:
        kept.unpersist()


def main() -> None:
    from tarmac.plans.sinks import save_benchmark, show
    from tarmac.registry import flight_queries
    from tarmac.sources.files import session
    from tarmac.sources.flights import load_flights

    names = {("1", "df"): "q1_monthly_stats", ("1", "sql"): "q1_monthly_stats_sql", ("2", "df"): "q2_top_delay", ("2", "sql"): "q2_top_delay_sql", ("3", "df"): "q3_percentiles_approx", ("3", "sql"): "q3_percentiles_approx_sql", ("3", "exact"): "q3_percentiles_exact", ("3", "kll"): "q3_percentiles_kll", ("3", "tdigest"): "q3_percentiles_tdigest"}
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--q", choices=sorted({q for q, _ in names}))
    p.add_argument("--api", choices=sorted({a for _, a in names}))
    p.add_argument("--runs", type=int, default=RUNS)
    p.add_argument("--all", action="store_true")
    p.add_argument("--input", required=True, help="Parquet directory of flights")
    p.add_argument("--output", help="directory for the CSV files")
    a = p.parse_args()
    picked = {k: n for k, n in names.items() if a.all or (k == (a.q, a.api))}
    if not picked:
        p.error("give --all, or a --q and --api that go together")
    spark = session("benchmark")
    made, rows = flight_queries(), []
    for (q, api), name in picked.items():
        flights = load_flights(spark, a.input)
        rows += [(f"q{q}", api, i + 1, s) for i, s in enumerate(timed(lambda n=name, f=flights: made[n](f), a.runs))]
    found = summary(spark, rows)
    show(found, "benchmark")
    if a.output:
        save_benchmark(spark, [dict(zip(("query", "api", "run", "compute_time"), r, strict=True)) for r in rows], f"{a.output}/runs")
        save_benchmark(spark, [r.asDict() for r in found.collect()], f"{a.output}/summary")


if __name__ == "__main__":
    main()
