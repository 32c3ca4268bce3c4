"""Top carriers, their features, correlations and standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.expressions import BASE, EXTRA, features

CARRIER, TOP, REDUNDANT = "OP_UNIQUE_CARRIER", 15, 0.8


def top_carriers(flights: DataFrame, n: int = TOP) -> DataFrame:
    """The carriers with most flights; ties by carrier."""
    return flights.groupBy(CARRIER).agg(F.count("*").alias("total_flights")).orderBy(F.desc("total_flights"), CARRIER).limit(n)


def flights_of_top_carriers(flights: DataFrame, n: int = TOP) -> DataFrame:
    """The flights of those carriers, by a semi join with at most ``n`` rows (which bounds the broadcast)."""
    return flights.join(F.broadcast(top_carriers(flights, n).select(CARRIER)), CARRIER, "left_semi")


def carrier_features(flights: DataFrame, names: Sequence[str], n: int = TOP) -> DataFrame:
    """total_flights and the named features of the top carriers.

    Every carrier is aggregated and the top is taken of the result: the aggregate is grouped by carrier
    anyway, so the flights are read once.
    """
    made = features()
    out = flights.groupBy(CARRIER).agg(F.count("*").alias("total_flights"), *[made[c].alias(c) for c in names])
    return out.orderBy(F.desc("total_flights"), CARRIER).limit(n)


def _filled(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))


def _corr(a: str, b: str) -> Column:
    # not F.corr, which fails on a constant column under ANSI
    x, y = _filled(a), _filled(b)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def feature_correlation(table: DataFrame, names: Sequence[str] = (*BASE, *EXTRA), extra: Sequence[str] = EXTRA) -> DataFrame:
    """extra_feature, feature, r (4 digits): Pearson correlation over the carriers; 0 where it is undefined."""
    pairs = [(e, c) for e in extra for c in names if e != c]
    row = table.agg(*[_corr(e, c).alias(f"{e}|{c}") for e, c in pairs])
    entries = F.array(*[F.struct(F.lit(e).alias("extra_feature"), F.lit(c).alias("feature"), F.lit(i).alias("i"), F.col(f"`{e}|{c}`").alias("raw")) for i, (e, c) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("x")).select("x.*").withColumn("r", F.round("raw", 4))


def feature_redundancy(table: DataFrame, names: Sequence[str] = (*BASE, *EXTRA), extra: Sequence[str] = EXTRA, threshold: float = REDUNDANT) -> DataFrame:
    """extra_feature, best_correlate, max_abs_corr and verdict; of equal correlates the first."""
    pairs = feature_correlation(table, names, extra)
    best = pairs.groupBy("extra_feature").agg(F.max_by("feature", F.struct(F.abs("raw"), -F.col("i"))).alias("best_correlate"), F.max(F.abs("raw")).alias("_m"))
    verdict = F.when(F.col("_m") >= threshold, "REDUNDANT").otherwise("KEEP")
    return best.select("extra_feature", "best_correlate", F.round("_m", 4).alias("max_abs_corr"), verdict.alias("verdict"))


def correlation_report(table: DataFrame, names: Sequence[str] = (*BASE, *EXTRA), extra: Sequence[str] = EXTRA, threshold: float = REDUNDANT) -> DataFrame:
    """``feature_redundancy`` with a column corr_<feature> for each feature."""
    wide = feature_correlation(table, names, extra).groupBy("extra_feature").pivot("feature", list(names)).agg(F.first("r"))
    cols = [F.when(F.col("extra_feature") == c, F.lit(1.0)).otherwise(F.col(c)).alias(f"corr_{c}") for c in names]
    return feature_redundancy(table, names, extra, threshold).join(wide, "extra_feature").select("extra_feature", "best_correlate", "max_abs_corr", "verdict", *cols)


def global_stats(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, mean, std: over carriers, each weighing the same; a std that is 0 or undefined becomes 1."""
    row = table.agg(*[F.avg(c).alias(f"{c}__m") for c in names], *[F.stddev_samp(c).alias(f"{c}__s") for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("s")) for c in names])
    out = row.select(F.explode(entries).alias("x")).select("x.*")
    std = F.when(F.col("s").isNull() | F.isnan("s") | (F.col("s") == 0), 1.0).otherwise(F.col("s"))
    return out.select("feature", "mean", std.alias("std"))


def zscores(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Carrier, feature, zscore (4 digits)."""
    long = table.unpivot([CARRIER], list(names), "feature", "value")
    return long.join(F.broadcast(global_stats(table, names)), "feature").select(CARRIER, "feature", F.round((F.col("value") - F.col("mean")) / F.col("std"), 4).alias("zscore"))
