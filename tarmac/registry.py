"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.expressions import BASE, EXTRA, hour
from tarmac.functions.quantiles import exact_quantiles
from tarmac.functions.sketches import kll_merged, kll_read, kll_states, rank_errors, tdigest_quantiles
from tarmac.operators import carriers, delays
from tarmac.plans import geometry, harness, serving, sinks, sql, study
from tarmac.sources import files, flights as flight_table, keyvalue
from tarmac.sources.flights import fixture_flights


def _by_sql(text: str) -> Callable[[DataFrame], DataFrame]:
    return lambda flights: flights.sparkSession.sql(text.replace("FROM flights", "FROM {flights}"), flights=flights)


def _global_stats(flights: DataFrame) -> DataFrame:
    stats = carriers.global_stats(carriers.carrier_features(flights, BASE), BASE)
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


#: The rank error that a sketch may have, and the size of stored sketches.
RANK_ERROR, STORED_K = 0.015, 800


def _close(flights: DataFrame, percentiles) -> DataFrame:
    errors = rank_errors(delays.flown_by_hour(flights), percentiles(flights), delays.KEYS, "DEP_DELAY", delays.RANKS)
    return errors.select(*delays.KEYS, "percentile", (F.col("rank_error") <= RANK_ERROR).alias("close"))


def _merged_sketches(flights: DataFrame) -> DataFrame:
    """KLL states stored by carrier and hour, merged from the stored states to carriers and to all: rows under each, and whether its quantiles keep the rank error."""
    rows = delays.flown_by_hour(flights).withColumn("everything", F.lit("all"))
    states = files.written(kll_states(rows, (*delays.KEYS, "everything"), "DEP_DELAY", STORED_K))
    out = []
    for level, keys in (("hour", delays.KEYS), ("carrier", delays.KEYS[:1]), ("all", ("everything",))):
        merged = files.written(kll_merged(states, keys))
        errors = rank_errors(rows, kll_read(merged, keys, delays.RANKS), keys, "DEP_DELAY", delays.RANKS)
        both = errors.join(merged.select(*keys, F.kll_sketch_get_n_float("state").alias("n")), list(keys))
        key = [F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in zip(delays.KEYS, ("string", "long"), strict=True)]
        out.append(both.select(F.lit(level).alias("level"), *key, "percentile", "n", (F.col("rank_error") <= RANK_ERROR).alias("close")))
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Ranks far from the middle, where a digest's centroids are small.
TAILS, TAIL_ERROR = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}, 0.005


def _spread(flights: DataFrame) -> DataFrame:
    """Flown flights with delays told apart by their scheduled minute: a digest interpolates, and among few whole minutes that alone is an error of half a value's rows."""
    rows = flights.where(F.col("OP_UNIQUE_CARRIER").isin(*delays.HOURLY_CARRIERS) & (F.col("CANCELLED") == 0))
    return rows.select("OP_UNIQUE_CARRIER", hour().alias("hour"), (F.col("DEP_DELAY") + F.col("CRS_DEP_TIME") % 100 / 100).alias("delay"))


def _digest_errors(flights: DataFrame, keys: tuple[str, ...], ranks: dict[str, float], most: float) -> DataFrame:
    rows = _spread(flights)
    errors = rank_errors(rows, tdigest_quantiles(rows, keys, "delay", ranks, digits=6), keys, "delay", ranks)
    return errors.select(*keys, "percentile", (F.col("rank_error") <= most).alias("close"))


def _selected_overall(flights: DataFrame) -> DataFrame:
    """Quantiles of all flown flights' delays, as one group."""
    rows = flights.where("CANCELLED = 0").select(F.lit("all").alias("flights"), "DEP_DELAY")
    return exact_quantiles(rows, ("flights",), "DEP_DELAY", delays.RANKS | TAILS)


def _saved(df: DataFrame) -> str:
    path = files.scratch(df.sparkSession, "csv")
    sinks.save_csv(df, path)
    return path


def _ingested(flights: DataFrame) -> DataFrame:
    """Flights written as raw CSV, ingested into the partitioned Parquet table and loaded from it: totals by carrier and year."""
    spark = flights.sparkSession
    raw, target = files.scratch(spark, "csv"), files.scratch(spark, "flights")
    flights.write.option("header", True).csv(raw)
    flight_table.ingest_csv(spark, raw, target)
    loaded = flight_table.load_flights(spark, target)
    return loaded.groupBy("OP_UNIQUE_CARRIER", "YEAR").agg(F.count("*").alias("flights"), F.round(F.sum("ARR_DELAY"), 2).alias("arr_delay"), F.count("DEP_DELAY").alias("dep_delays"))


def _viewed(flights: DataFrame) -> DataFrame:
    flight_table.register(flights, "tarmac_flights")
    return flights.sparkSession.sql("SELECT OP_UNIQUE_CARRIER, max(ARR_DELAY) AS worst FROM tarmac_flights GROUP BY OP_UNIQUE_CARRIER")


def _published(f: DataFrame, *runs: tuple[str, DataFrame, str]) -> str:
    path = files.scratch(f.sparkSession, "store")
    for run, rows, mode in runs:
        keyvalue.put(rows, path, run, mode)
    return path


def _store_round_trip(f: DataFrame) -> DataFrame:
    """All hashes and the ranking, written as three runs and read again."""
    q2 = delays.top_delays(f)
    path = _published(
        f,
        ("q1", serving.entries(serving.q1_hash(delays.monthly_stats(f))), "overwrite"),
        ("q2", serving.entries(serving.q2_hash(q2), serving.q2_ranking(q2)), "overwrite"),
        ("q3", serving.entries(serving.q3_hash(delays.percentiles_exact(f))), "overwrite"),
    )
    return keyvalue.get(f.sparkSession, path)


def _store_second_run(f: DataFrame) -> DataFrame:
    """Two carriers' months, overwritten by a run of one carrier: no key of the other is left."""
    q1 = delays.monthly_stats(f)
    path = _published(f, ("q1", serving.entries(serving.q1_hash(q1)), "overwrite"), ("q1", serving.entries(serving.q1_hash(q1.where("OP_UNIQUE_CARRIER = 'DL'"))), "overwrite"))
    return serving.hashes_of(keyvalue.get(f.sparkSession, path, "q1"))


def _store_added(f: DataFrame) -> DataFrame:
    """Months of one carrier appended to another's, with some of its keys written anew, in fewer fields."""
    q1 = delays.monthly_stats(f)
    again = serving.q1_hash(q1.where("OP_UNIQUE_CARRIER = 'AA' AND MONTH = 1")).where("field = 'total_flights'")
    path = _published(
        f,
        ("q1", serving.entries(serving.q1_hash(q1.where("OP_UNIQUE_CARRIER = 'AA'"))), "overwrite"),
        ("q1", serving.entries(serving.q1_hash(q1.where("OP_UNIQUE_CARRIER = 'DL'")).unionByName(again)), "append"),
    )
    return serving.hashes_of(keyvalue.get(f.sparkSession, path, "q1"))


def _store_lookup(f: DataFrame) -> DataFrame:
    """The three worst carriers as a panel reads them: the ranking's key alone."""
    path = _published(f, ("q2", serving.entries(serving.q2_hash(q2 := delays.top_delays(f)), serving.q2_ranking(q2)), "overwrite"))
    return serving.top(serving.rankings_of(keyvalue.get(f.sparkSession, path, "q2", ["q2:ranking"])))


def _panel_latest(f: DataFrame) -> DataFrame:
    """Each carrier's last monthly cancellation rate, under the name that a panel shows."""
    rows = serving.renamed(serving.q1_hash(delays.monthly_stats(f)), {"cancellation_rate_pct": "Cancelled %"}).where("field = 'Cancelled %'")
    parts = F.split("key", ":")
    dated = rows.select(F.concat_ws(":", parts[0], parts[1]).alias("key"), "field", "value", (parts[2].cast("int") * 12 + parts[3].cast("int")).alias("month"))
    return serving.latest(dated, "month").join(dated.groupBy("key").agg(F.first("field").alias("field")), "key")


def _points(flights: DataFrame) -> DataFrame:
    table = carriers.carrier_features(flights, BASE)
    return geometry.points(flights.sparkSession.createDataFrame(table.collect(), table.schema), BASE)  # 15 carriers at most


def _recursive_clusters(flights: DataFrame) -> DataFrame:
    return geometry.kmeans(_points(flights), study.K_RANGE).withColumn("wssse", F.round("wssse", 4))


def _moment_silhouettes(flights: DataFrame) -> DataFrame:
    points = _points(flights)
    rows = geometry.kmeans(points, study.K_RANGE).join(points, "OP_UNIQUE_CARRIER")
    return geometry.silhouette(rows, ("k",)).withColumn("silhouette", F.round("silhouette", 4))


def _axes(flights: DataFrame) -> DataFrame:
    out = geometry.principal_axes(_points(flights))
    return out.select("OP_UNIQUE_CARRIER", *[F.round(c, 3).alias(c) for c in out.columns[1:]])


def _optional(f: DataFrame) -> DataFrame:
    """The carriers of a file that is there and of one that is not."""
    columns = ["OP_UNIQUE_CARRIER", "total_flights"]
    here = files.read_optional(f.sparkSession, _saved(carriers.top_carriers(f)), columns)
    return here.unionByName(files.read_optional(f.sparkSession, files.scratch(f.sparkSession, "csv"), columns))


def _looked_up(f: DataFrame) -> DataFrame:
    """Flights by the description of their carrier, from a lookup file."""
    lookup = f.select(F.col("OP_UNIQUE_CARRIER").alias("Code"), F.concat(F.lit("Carrier, "), F.lower("OP_UNIQUE_CARRIER")).alias("Description")).distinct()
    known = files.read_lookup(f.sparkSession, _saved(lookup))
    return f.join(known, f["OP_UNIQUE_CARRIER"] == known["Code"]).groupBy("Description").agg(F.count("*").alias("flights"))


def _quarantined(f: DataFrame) -> DataFrame:
    """Raw CSV with unreadable delays and times, ingested: accepted rows by carrier, and rejected values by column."""
    spark = f.sparkSession
    raw, target = files.scratch(spark, "csv"), files.scratch(spark, "flights")
    text = f.withColumns({"DEP_DELAY": F.when(F.col("ARR_DELAY") == 7, "n/a").otherwise(F.col("DEP_DELAY").cast("string")), "CRS_DEP_TIME": F.when(F.col("CRS_DEP_TIME") % 100 == 21, "12:21").otherwise(F.col("CRS_DEP_TIME").cast("string"))})
    text.write.option("header", True).csv(raw)
    flight_table.ingest_checked(spark, raw, target)
    good = flight_table.accepted(spark, target).groupBy(F.lit("accepted").alias("kind"), F.col("OP_UNIQUE_CARRIER").alias("name"), F.lit(None).cast("string").alias("value")).agg(F.count("*").alias("n"), F.sum("DEP_DELAY").alias("delay"))
    bad = flight_table.rejected(spark, target).select(F.explode("reasons").alias("r"), "DEP_DELAY")
    return good.unionByName(bad.groupBy(F.lit("rejected").alias("kind"), F.col("r.column").alias("name"), F.col("r.value").alias("value")).agg(F.count("*").alias("n"), F.sum("DEP_DELAY").alias("delay")))


def _stored_months(f: DataFrame) -> DataFrame:
    """The first quarters of two years, from a stored table of which only their months are read."""
    spark = f.sparkSession
    target = files.scratch(spark, "flights")
    flight_table.store_flights(f, target)
    months = files.written(f.select("YEAR", "MONTH").distinct().withColumn("quarter", F.ceil(F.col("MONTH") / 3)))
    rows = flight_table.flights_of(spark, target, (1995, 1996), months.where("quarter = 1"))
    return rows.groupBy("OP_UNIQUE_CARRIER", "YEAR", "MONTH").agg(F.count("*").alias("flights"), F.sum("ARR_DELAY").alias("arr_delay"))


def _ordered(f: DataFrame) -> DataFrame:
    """All flights, written as files in the order of carrier and time, and read again."""
    path = files.scratch(f.sparkSession, "ordered")
    sinks.save_ordered(f, path, ["OP_UNIQUE_CARRIER", "YEAR", "MONTH", "CRS_DEP_TIME", "DEP_DELAY", "ARR_DELAY"], 8)
    return f.sparkSession.read.parquet(path)


def _one_scan(f: DataFrame) -> DataFrame:
    """Percentiles by hour and ranges by carrier of one scan of the flights, with the rows it has seen."""
    rows = delays.flown_by_hour(f)
    with harness.one_scan(rows, rows=F.count("*"), known=F.count("DEP_DELAY"), worst=F.max("DEP_DELAY")) as (kept, seen):
        p = F.percentile("DEP_DELAY", 0.5)
        median = files.written(kept.na.drop(subset=["DEP_DELAY"]).groupBy(*delays.KEYS).agg(F.round(p, 2).alias("median")))
        span = files.written(kept.groupBy("OP_UNIQUE_CARRIER").agg(F.min("DEP_DELAY").alias("min_delay"), F.max("DEP_DELAY").alias("max_delay")))
        found = seen.get
    return median.join(span, "OP_UNIQUE_CARRIER").select("*", *[F.lit(found[n]).cast("long").alias(n) for n in ("rows", "known")], F.lit(found["worst"]).alias("worst"))


def _cluster_profile(f: DataFrame) -> DataFrame:
    """Means of the features in three recursive clusters, and how far they are from all carriers' means."""
    table = carriers.carrier_features(f, BASE)
    table = f.sparkSession.createDataFrame(table.collect(), table.schema)
    own = geometry.kmeans(geometry.points(table, BASE), [3]).select("OP_UNIQUE_CARRIER", F.col("cluster").alias("prediction"))
    return study.profile(table.join(own, "OP_UNIQUE_CARRIER"), table, BASE)


def _statistics(f: DataFrame) -> DataFrame:
    """The benchmark's statistics, of arrival delays as if they were times of runs."""
    rows = f.where("ARR_DELAY IS NOT NULL").select(F.col("OP_UNIQUE_CARRIER").alias("query"), F.col("MONTH").cast("string").alias("api"), F.col("ARR_DELAY").alias("compute_time"))
    return harness.statistics(rows).withColumns({c: F.round(c, 6) for c in ("avg", "median", "variance")})


def flight_queries() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """name -> a function of the flight table."""
    every = (*BASE, *EXTRA)
    table = lambda f: carriers.carrier_features(f, every)
    q1, q2, q3 = delays.monthly_stats, delays.top_delays, delays.percentiles_exact
    return {
        "q1_monthly_stats": q1,
        "q1_monthly_stats_sql": _by_sql(sql.MONTHLY_STATS),
        "q2_top_delay": q2,
        "q2_top_delay_sql": _by_sql(sql.TOP_DELAYS),
        "q3_percentiles_approx": delays.percentiles_approx,
        "q3_percentiles_approx_sql": _by_sql(sql.PERCENTILES_APPROX),
        "q3_percentiles_exact": q3,
        "q3_percentiles_kll": delays.percentiles_kll,
        "q3_percentiles_tdigest": delays.percentiles_tdigest,
        "q3_delay_range": delays.delay_range,
        "q3_delay_range_sql": _by_sql(sql.DELAY_RANGE),
        "q3_delay_rollup": delays.delay_rollup,
        "top_carriers": carriers.top_carriers,
        "flights_of_top_carriers": carriers.flights_of_top_carriers,
        "features_base": lambda f: carriers.carrier_features(f, BASE),
        "features_extended": table,
        "feature_correlation": lambda f: carriers.feature_correlation(table(f)).select("extra_feature", "feature", "r"),
        "feature_redundancy": lambda f: carriers.feature_redundancy(table(f)),
        "feature_global_stats": _global_stats,
        "feature_zscores": lambda f: carriers.zscores(carriers.carrier_features(f, BASE), BASE),
        "kmeans_k_metrics": lambda f: study.run_study(f).k_metrics(),
        "kmeans_assignments": lambda f: study.run_study(f).assignments(),
        "kmeans_profile": lambda f: study.run_study(f).profile(),
        "pca_coords": lambda f: study.run_study(f).pca(),
        "study_summary": lambda f: study.comparison(study.run_studies(f)),
        "kmeans_recursive": _recursive_clusters,
        "kmeans_silhouettes": _moment_silhouettes,
        "pca_covariance": _axes,
        "study_standard_scores": lambda f: study.run_study(f).standard_scores(),
        "study_costs": lambda f: study.run_study(f).recomputed().drop("best"),
        "correlation_report": lambda f: carriers.correlation_report(table(f)),
        "q3_kll_rank_error": lambda f: _close(f, lambda f: delays.percentiles_kll(f, k=STORED_K)),
        "q3_kll_merged": _merged_sketches,
        "q3_tdigest_tails": lambda f: _digest_errors(f, delays.KEYS[:1], TAILS, TAIL_ERROR),
        "q3_percentiles_selected": lambda f: delays.percentiles_selected(f),
        "q3_selected_overall": _selected_overall,
        "q3_tdigest_rank_error": lambda f: _digest_errors(f, delays.KEYS, delays.RANKS, RANK_ERROR),
        "csv_round_trip": lambda f: files.read_csv_text(f.sparkSession, _saved(q1(f))),
        "csv_by_position": lambda f: files.read_csv_named(f.sparkSession, _saved(carriers.top_carriers(f)), ["OP_UNIQUE_CARRIER", "total_flights"]),
        "csv_optional_missing": _optional,
        "csv_lookup": _looked_up,
        "csv_quarantine": _quarantined,
        "stored_months": _stored_months,
        "flights_in_order": _ordered,
        "q3_one_scan": _one_scan,
        "cluster_profile": _cluster_profile,
        "study_deltas": lambda f: study.deltas(study.comparison(study.run_studies(f))),
        "csv_ingest": _ingested,
        "view_by_sql": _viewed,
        "benchmark_summary": _statistics,
        "serve_q1_hash": lambda f: serving.q1_hash(q1(f)),
        "serve_q2_ranking": lambda f: serving.q2_ranking(q2(f)),
        "serve_q2_hash": lambda f: serving.q2_hash(q2(f)),
        "serve_q3_hash": lambda f: serving.q3_hash(q3(f)),
        "serve_q1_viz": lambda f: serving.q1_viz(q1(f)),
        "serve_q2_viz": lambda f: serving.q2_viz(q2(f)),
        "serve_q3_viz": lambda f: serving.q3_viz(q3(f)),
        "store_round_trip": _store_round_trip,
        "store_second_run": _store_second_run,
        "store_added": _store_added,
        "store_lookup": _store_lookup,
        "panel_latest": _panel_latest,
        "serve_top3": lambda f: serving.top(serving.q2_ranking(q2(f))),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: lambda spark, d, q=q: q(fixture_flights(spark, d)) for n, q in flight_queries().items()}


ORACLES = sql.ORACLES
