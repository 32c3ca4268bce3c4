"""The clustering study: standardised carrier features, K-Means over a range of k, the best silhouette, PCA and profiles.

After aggregation there are at most 15 rows. They are put in one partition in the order of the carrier before
each fit, so that the seeded initialisation sees the same rows in the same order on every run.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.expressions import BASE, EXTRA
from tarmac.operators.carriers import CARRIER, carrier_features, feature_redundancy, global_stats

K_RANGE, SEED = range(2, 7), 42


def standardised(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``table`` with the vector ``features``: nulls as 0, mean 0 and sample deviation 1."""
    rows = table.select(CARRIER, "total_flights", *[F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names])
    rows = rows.repartition(1).sortWithinPartitions(CARRIER)
    raw = VectorAssembler(inputCols=list(names), outputCol="features_raw").transform(rows)
    return StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True).fit(raw).transform(raw)


@dataclass
class Sweep:
    """A model per k, the within-cluster sums and silhouettes, and the first k of the highest silhouette."""

    models: dict
    wssse: dict
    silhouette: dict

    @property
    def best_k(self) -> int:
        return max(self.silhouette, key=lambda k: (self.silhouette[k], -k))


def sweep(scaled: DataFrame, ks: Sequence[int] = K_RANGE, seed: int = SEED) -> Sweep:
    """Values of k that the rows do not allow (fewer rows than k) are left out."""
    n = scaled.count()
    judge = ClusteringEvaluator(featuresCol="features", metricName="silhouette", distanceMeasure="squaredEuclidean")

    def fitted(k: int) -> tuple:
        model = KMeans(k=k, seed=seed, maxIter=100, initSteps=10, featuresCol="features").fit(scaled)
        assigned = model.transform(scaled)
        clusters = assigned.select("prediction").distinct().count()
        return k, model, float(model.summary.trainingCost), float(judge.evaluate(assigned)) if clusters > 1 and n > 2 else 0.0

    # a fit is many short jobs one after another; the fits do not depend on each other
    with ThreadPoolExecutor(max(1, len(ks))) as pool:
        found = list(pool.map(fitted, [k for k in ks if k <= n]))
    return Sweep({k: m for k, m, _, _ in found}, {k: c for k, _, c, _ in found}, {k: s for k, _, _, s in found})


def profile(assigned: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """prediction, n_carriers, and per feature its mean, its distance to the mean of all carriers, and that in deviations (4 digits).

    Features have few digits, so that distances often lie halfway between two roundings; means are of decimals, as a sum of
    doubles would round by the order of its rows.
    """
    exact = {c: F.avg(F.col(c).try_cast("decimal(28,10)")) for c in names}
    stats = global_stats(table, names).groupBy().pivot("feature", list(names)).agg(F.first("std").alias("s"))
    stats = stats.select(*[F.col(c).alias(f"{c}_s") for c in names]).join(F.broadcast(table.agg(*[x.alias(f"{c}_m") for c, x in exact.items()])))
    means = assigned.groupBy("prediction").agg(F.count("*").alias("n_carriers"), *[x.alias(c) for c, x in exact.items()])
    both = means.join(F.broadcast(stats))  # a single row of statistics
    cols = []
    for c in names:
        delta = F.col(c) - F.col(f"{c}_m")
        cols += [F.round(c, 4).cast("double").alias(f"{c}_mean"), F.round(delta, 4).cast("double").alias(f"{c}_delta"), F.round(delta.cast("double") / F.col(f"{c}_s"), 4).alias(f"{c}_zscore")]
    return both.select("prediction", "n_carriers", *cols).orderBy("prediction")


@dataclass
class Study:
    name: str
    features: list[str]
    table: DataFrame
    assigned: DataFrame
    sweep: Sweep
    redundancy: DataFrame | None
    seconds: float

    def k_metrics(self) -> DataFrame:
        rows = [(k, round(self.sweep.wssse[k], 4), round(self.sweep.silhouette[k], 4)) for k in self.sweep.models]
        return self.table.sparkSession.createDataFrame(rows, "k int, wssse double, silhouette double")

    def assignments(self) -> DataFrame:
        return self.assigned.select(CARRIER, "total_flights", *self.features, "prediction").orderBy("prediction", CARRIER)

    def profile(self) -> DataFrame:
        return profile(self.assigned, self.table, self.features)

    def standard_scores(self) -> DataFrame:
        """Carrier, feature and its standardised value (4 digits)."""
        x = vector_to_array("features")
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(x[i], 4).alias("value")) for i, c in enumerate(self.features)])
        return self.assigned.select(CARRIER, F.explode(entries).alias("x")).select(CARRIER, "x.*")

    def recomputed(self) -> DataFrame:
        """k, and whether the assignments' own squared distances to their clusters' means add up to the model's cost and to no less than the next k's."""
        rows = []
        for k, model in self.sweep.models.items():
            x = vector_to_array("features")
            wide = model.transform(self.assigned.drop("prediction")).select("prediction", F.posexplode(x).alias("i", "x"))
            mean = wide.groupBy("prediction", "i").agg(F.avg("x").alias("m"))
            cost = wide.join(mean, ["prediction", "i"]).agg(F.sum(F.pow(F.col("x") - F.col("m"), 2))).first()[0]
            rows.append((k, bool(abs(cost - self.sweep.wssse[k]) < 1e-6 * (1 + cost)), bool(-1 <= self.sweep.silhouette[k] <= 1), k == self.sweep.best_k))
        return self.table.sparkSession.createDataFrame(rows, "k int, cost_matches boolean, silhouette_in_range boolean, best boolean")

    def pca(self, k: int = 2) -> DataFrame:
        """Carrier, coordinates, prediction, and the share of variance that each coordinate explains."""
        model = PCA(k=k, inputCol="features", outputCol="pca").fit(self.assigned)
        shares = [float(v) for v in model.explainedVariance]
        xy = vector_to_array("pca")
        out = model.transform(self.assigned).select(CARRIER, *[xy[i].alias(f"pc{i + 1}") for i in range(k)], "prediction")
        return out.select("*", *[F.lit(v).alias(f"explained_pc{i + 1}") for i, v in enumerate(shares)])

    def summary(self) -> tuple:
        k = self.sweep.best_k
        return self.name, self.name.upper(), len(self.features), ",".join(self.features), k, round(self.sweep.silhouette[k], 4), round(self.sweep.wssse[k], 4), round(self.seconds, 4)


def _held(table: DataFrame) -> DataFrame:
    """The rows of ``table``, a row for each of at most 15 carriers, kept in the plan itself, so that nothing is scanned again and no cache is left."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def run_study(flights: DataFrame, name: str = "base", features: Sequence[str] | None = None, table: DataFrame | None = None) -> Study:
    """The base study has the base features; the extended one adds those extra features that no other makes redundant.

    ``table`` has all their features of the top carriers, if they are known; else the flights are scanned.
    """
    began = time.time()
    wanted = list(features or (BASE if name == "base" else (*BASE, *EXTRA)))
    table = _held(carrier_features(flights, wanted) if table is None else table.select(CARRIER, "total_flights", *wanted))
    redundancy = None
    if extra := [c for c in wanted if c in EXTRA]:
        redundancy = feature_redundancy(table, wanted, extra)
        gone = {r["extra_feature"] for r in redundancy.where("verdict = 'REDUNDANT'").collect()}
        wanted = [c for c in wanted if c not in gone]
    scaled = standardised(table, wanted).cache()
    found = sweep(scaled)
    assigned = _held(found.models[found.best_k].transform(scaled))
    scaled.unpersist()
    return Study(name, wanted, table, assigned, found, redundancy, time.time() - began)


def run_studies(flights: DataFrame, names: Sequence[str] = ("base", "extended")) -> list[Study]:
    """The studies over one scan of the flights."""
    table = _held(carrier_features(flights, (*BASE, *EXTRA)))
    return [run_study(flights, n, table=table) for n in names]


def deltas(studies: DataFrame) -> DataFrame:
    """Each study against the first of ``comparison`` (the one of fewest features): what features, clusters, silhouette and cost it has more or less."""
    least = studies.agg(*[F.min_by(c, "n_features").alias(f"_{c}") for c in ("study", "best_k", "best_silhouette", "best_wssse")], F.min("n_features").alias("_n_features"))
    both = studies.join(F.broadcast(least), F.col("study") != F.col("_study"))
    cols = [F.round(F.col(c) - F.col(f"_{c}"), 4).alias(f"{c}_delta") for c in ("n_features", "best_k", "best_silhouette", "best_wssse")]
    return both.select("study", F.col("_study").alias("against"), *cols)


def comparison(studies: Sequence[Study]) -> DataFrame:
    schema = "study string, label string, n_features int, features string, best_k int, best_silhouette double, best_wssse double, elapsed_seconds double"
    return studies[0].table.sparkSession.createDataFrame([s.summary() for s in studies], schema)
