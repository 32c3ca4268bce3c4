"""Clusters and main axes of standardised carriers without fitting libraries: K-Means as one recursive query,
silhouettes from cluster moments, and principal axes from a covariance matrix summed in one pass.

K-Means carries its centres as arrays in the recursion, since there are at most 15 carriers; the others take any
number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.carriers import CARRIER

ROUNDS = 50


def points(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Carrier and x, the standardised features: nulls as 0, mean 0 and sample deviation 1 (a constant feature is 0)."""
    rows = table.select(CARRIER, *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names])
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return rows.select(CARRIER, F.array(*[(F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in names]).alias("x"))


def _far(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (u, v) -> (u - v) * (u - v)), 0D, (s, v) -> s + v)"


_NEAREST = f"array_position(transform(cs, c -> {_far('p', 'c')}), array_min(transform(cs, c -> {_far('p', 'c')}))) - 1"


def _lloyd(most: int, rounds: int) -> str:
    apart = f"transform(xs, p -> array_min(transform(chosen, i -> {_far('p', 'xs[i]')})))"
    mean = "transform(sequence(0, size(xs[0]) - 1), d -> aggregate(m, 0D, (s, p) -> s + p[d]) / size(m))"
    return f"""WITH RECURSIVE
 rows AS (SELECT array_sort(collect_list(struct({CARRIER} AS name, x))) AS r FROM {{points}}),
 seeds(xs, names, chosen) AS (
  SELECT transform(r, e -> e.x), transform(r, e -> e.name), array(0) FROM rows WHERE size(r) > 0
  UNION ALL
  SELECT xs, names, array_append(chosen, CAST(array_position(d, array_max(d)) - 1 AS INT)) FROM (SELECT *, {apart} AS d FROM seeds WHERE size(chosen) < least({most}, size(xs)))),
 lloyd(k, round, xs, names, cs, moved) AS (
  SELECT size(chosen), 0, xs, names, transform(chosen, i -> xs[i]), true FROM seeds
  UNION ALL
  SELECT k, round + 1, xs, names, new, new <> cs FROM (
   SELECT *, transform(sequence(0, k - 1), j -> if(exists(own, o -> o = j), transform(array(filter(xs, (p, i) -> own[i] = j)), m -> {mean})[0], cs[j])) AS new FROM (
    SELECT *, transform(xs, p -> {_NEAREST}) AS own FROM lloyd WHERE moved AND round < {rounds})))
 SELECT k, max_by(struct(xs, names, cs), round) AS last, max(round) AS rounds FROM lloyd GROUP BY k"""


def kmeans(points: DataFrame, ks: Sequence[int], rounds: int = ROUNDS) -> DataFrame:
    """k, carrier, cluster, and the sum of squared distances of all its carriers, for each k of ``ks`` that the rows allow.

    The first centre is the first carrier in the alphabet; each next one is the carrier farthest from those
    before (the first of equals). Then Lloyd's rounds go on until nothing moves. An empty cluster keeps its centre.
    """
    found = points.sparkSession.sql(_lloyd(max(ks), rounds), points=points).where(F.col("k").isin(*ks))
    wide = found.selectExpr("k", "last.xs AS xs", "last.names AS names", "last.cs AS cs")
    own = wide.selectExpr("k", "names", f"transform(xs, p -> struct(CAST({_NEAREST} AS INT) AS cluster, array_min(transform(cs, c -> {_far('p', 'c')})) AS far)) AS own")
    return own.selectExpr("k", "aggregate(own, 0D, (s, o) -> s + o.far) AS wssse", "explode(zip_with(names, own, (n, o) -> struct(n AS name, o.cluster AS cluster))) AS e").selectExpr("k", f"e.name AS {CARRIER}", "e.cluster AS cluster", "wssse")


def silhouette(rows: DataFrame, by: Sequence[str], cluster: str = "cluster", x: str = "x") -> DataFrame:
    """``by`` and the mean silhouette (squared distances) of its clusters: counts, sums and squared norms say how far a row is from a cluster on average.

    A row alone in its cluster has silhouette 0, and so have all rows of a single cluster. The moments are one
    row for each cluster, gathered as a list beside the rows of their ``by``.
    """
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    long = rows.select(*by, cluster, norm.alias("_q"), F.posexplode(x).alias("_i", "_v"))
    sums = long.groupBy(*by, cluster, "_i").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"), F.avg("_q").alias("_m"))
    one = sums.groupBy(*by, cluster).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_s"), F.max("_n").alias("_n"), F.max("_m").alias("_m"))
    moments = one.groupBy(*by).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), F.transform("_s", lambda e: e["_s"]).alias("s"), F.col("_n").alias("n"), F.col("_m").alias("q"))).alias("_all"))

    def apart(m: Column) -> Column:
        """The mean squared distance to a cluster's rows."""
        dot = F.aggregate(F.zip_with(x, m["s"], lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.col("_q") - 2 * dot / m["n"] + m["q"], F.lit(0.0))

    both = rows.withColumn("_q", norm).join(moments, list(by))
    mine = F.filter("_all", lambda m: m["c"] == F.col(cluster))[0]
    others = F.array_min(F.transform(F.filter("_all", lambda m: m["c"] != F.col(cluster)), apart))
    judged = both.select(*by, mine["n"].alias("_n"), (apart(mine) * mine["n"] / F.greatest(mine["n"] - 1, F.lit(1))).alias("_a"), others.alias("_b"))
    score = F.when((F.col("_n") > 1) & F.col("_b").isNotNull() & (F.greatest("_a", "_b") > 0), (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).otherwise(0.0)
    return judged.groupBy(*by).agg(F.avg(score).alias("silhouette"))


def covariance(rows: DataFrame, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """The means and the sample covariance matrix of the components of ``x``, from sums of one pass; the matrix alone reaches the driver."""
    entries = rows.select(F.posexplode(x).alias("i", "u"), F.col(x).alias("_x")).select("i", "u", F.posexplode("_x").alias("j", "v")).where("i <= j")
    found = entries.groupBy("i", "j").agg(F.covar_samp("u", "v").alias("c"), F.avg("u").alias("m")).collect()
    n = 1 + max((r["j"] for r in found), default=-1)
    mean, matrix = np.zeros(n), np.zeros((n, n))
    for r in found:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["c"] or 0.0
        mean[r["i"]] = r["m"]
    return mean, matrix


def principal_axes(rows: DataFrame, k: int = 2, x: str = "x") -> DataFrame:
    """``rows`` without ``x``, with coordinates pc1 to pck on the axes of greatest variance, and the share of all variance that each has.

    Of an axis's two directions the one whose component of greatest size is positive is taken.
    """
    mean, matrix = covariance(rows, x)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    out = []
    for n, axis in enumerate(order, 1):
        v = vectors[:, axis] * (1.0 if vectors[np.abs(vectors[:, axis]).argmax(), axis] > 0 else -1.0)
        out.append(sum((F.element_at(x, i + 1) - float(mean[i])) * float(c) for i, c in enumerate(v)).alias(f"pc{n}"))
    shares = [F.lit(float(values[a] / (values.sum() or 1.0))).alias(f"explained_pc{n}") for n, a in enumerate(order, 1)]
    return rows.select(*[c for c in rows.columns if c != x], *out, *shares)
