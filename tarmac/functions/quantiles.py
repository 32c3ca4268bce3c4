"""Exact quantiles by distributed selection: no group of rows ever meets in one task.

Each round counts the rows of every open interval of values in buckets; prefix counts over the buckets show
which of them hold the wanted positions, and the least and greatest values of those are the next intervals. An
interval of a single value is done. What is joined, sorted or windowed is intervals and buckets, a bounded
number for each group and wanted position, however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.files import written

#: Buckets of an interval in each round.
BUCKETS = 1024


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def _positions(ranks: dict[str, float]) -> Column:
    """The rows, counted from 0 in the order of the values, between which the ranks lie."""
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in ranks.values()]
    return F.array_sort(F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))


def _logarithm(x: Column) -> Column:
    """In the order of the values, and even over all of their magnitudes."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746))


def narrowed(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, by_magnitude: bool = False) -> DataFrame:
    """The intervals that hold the wanted positions of ``intervals`` (keys, _lo, _hi, _base: rows below it, _at: positions), from one pass over ``rows``.

    Buckets are of equal width, or of equal ratio (``by_magnitude``).
    """
    own = intervals.withColumnsRenamed({k: f"_{k}" for k in keys})
    inside = rows.join(own.drop("_at"), _same(rows, own, keys) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    # halves, so that the width of an interval is finite; the ends have buckets of their own, so that every round divides
    v, lo, hi = (_logarithm(F.col(c)) if by_magnitude else F.col(c) / 2 for c in ("_v", "_lo", "_hi"))
    share = F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))
    bucket = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), buckets - 1).otherwise(1 + F.least(F.floor(share * (buckets - 2)), F.lit(buckets - 3)))
    counted = inside.groupBy(*keys, "_base", bucket.cast("int").alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    before = F.sum("_c").over(Window.partitionBy(*keys, "_base").orderBy("_b")) - F.col("_c")
    placed = counted.withColumn("_from", F.col("_base") + before)
    wanted = own.select(*[f"_{k}" for k in keys], F.col("_base").alias("_own"), F.col("_at").alias("_all"))
    held = placed.join(wanted, _same(placed, wanted, keys) & (F.col("_base") == F.col("_own")))
    held = held.withColumn("_at", F.filter("_all", lambda k: (k >= F.col("_from")) & (k < F.col("_from") + F.col("_c"))))
    return held.where(F.size("_at") > 0).select(*keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_from").alias("_base"), "_at")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, float], digits: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """``keys`` and a quantile per rank, interpolated at q (n - 1). Nulls and NaN are left out, and groups of nothing else; keys may be null.

    Each round scans ``df`` once, with the interval's rows found by a join on the keys; rounds go on until every
    wanted position lies among equal values (two or three for ordinary data). Rounds divide by width and by
    magnitude in turn, so that values of any scale take few.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_at", _positions(ranks)))
    now, done = stats.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_base"), "_at"), []
    while True:
        done.append(now.where("_lo = _hi"))
        if now.where("_lo < _hi").isEmpty():
            break
        now = written(narrowed(rows, now.where("_lo < _hi"), keys, buckets, by_magnitude=len(done) % 2 == 0))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.select(*keys, F.explode("_at").alias("_k"), F.col("_lo").alias("_v"))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_values")).withColumnsRenamed({k: f"_{k}" for k in keys})
    both = stats.join(values, _same(stats, values, keys))
    cols = []
    for name, q in ranks.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = (F.element_at("_values", f(at).cast("long")) for f in (F.floor, F.ceil))
        cols.append(F.round(low + (high - low) * (at - F.floor(at)), digits).alias(name))
    return both.select(*keys, *cols)
