"""Recursive K-Means, moment silhouettes and covariance axes against plain versions."""

import numpy as np
import pytest

from tarmac.plans import geometry


def table(spark, seed=0, n=12, dims=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 3, (n, 1)) * 4
    return x, spark.createDataFrame([(f"c{i:02}", [float(v) for v in r]) for i, r in enumerate(x)], "OP_UNIQUE_CARRIER string, x array<double>")


def lloyd(x, k):
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1).argmax()))
    c = x[chosen].copy()
    while True:
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        if (new == c).all():
            return own, float(((x - c[own]) ** 2).sum())
        c = new


@pytest.mark.parametrize("seed", [0, 1])
def test_recursion_equals_lloyd(spark, seed):
    x, df = table(spark, seed)
    got = {(r["k"], r["OP_UNIQUE_CARRIER"]): (r["cluster"], r["wssse"]) for r in geometry.kmeans(df, [2, 3, 5, 20]).collect()}
    assert {k for k, _ in got} == {2, 3, 5}
    for k in (2, 3, 5):
        own, cost = lloyd(x, k)
        assert [got[k, f"c{i:02}"][0] for i in range(12)] == own.tolist() and got[k, "c00"][1] == pytest.approx(cost)


def test_recursion_of_few_and_equal_rows(spark):
    _, df = table(spark, n=2)
    assert {r["k"] for r in geometry.kmeans(df, [2, 3]).collect()} == {2}
    assert geometry.kmeans(df.where("false"), [2]).count() == 0
    same = spark.createDataFrame([(c, [1.0, 2.0]) for c in "abc"], "OP_UNIQUE_CARRIER string, x array<double>")
    assert {(r["cluster"], r["wssse"]) for r in geometry.kmeans(same, [2]).collect()} == {(0, 0.0)}


def test_silhouette_equals_pairs_and_the_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x, df = table(spark, 3, 40, 4)
    own, _ = lloyd(x, 4)
    rows = df.join(spark.createDataFrame([("all", f"c{i:02}", int(c)) for i, c in enumerate(own)], "g string, OP_UNIQUE_CARRIER string, cluster int"), "OP_UNIQUE_CARRIER")
    got = geometry.silhouette(rows, ["g"]).first()["silhouette"]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    scores = []
    for i in range(40):
        mine = own == own[i]
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a, b = d[i, mine].sum() / (mine.sum() - 1), min(d[i, own == c].mean() for c in set(own) - {own[i]})
        scores.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(scores))
    evaluated = ClusteringEvaluator(featuresCol="v", predictionCol="cluster").evaluate(rows.withColumn("v", array_to_vector("x")).withColumn("cluster", rows["cluster"].cast("double")))
    assert got == pytest.approx(evaluated)
    alone = rows.withColumn("cluster", rows["cluster"] * 0)
    assert geometry.silhouette(alone, ["g"]).first()["silhouette"] == 0.0


def test_axes_have_their_variances(spark):
    x, df = table(spark, 4, 200, 5)
    df = df.repartition(4)
    mean, matrix = geometry.covariance(df)
    assert np.allclose(mean, x.mean(0)) and np.allclose(matrix, np.cov(x.T))
    out = geometry.principal_axes(df, 3).collect()
    pcs = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in out])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(np.cov(pcs.T), np.diag(values[:3]), atol=1e-9)
    assert out[0]["explained_pc1"] == pytest.approx(values[0] / values.sum()) and out[0]["explained_pc3"] == pytest.approx(values[2] / values.sum())


def test_points_are_standardised(spark):
    df = spark.createDataFrame([("a", 1.0, None, 5.0), ("b", 3.0, 2.0, 5.0)], "OP_UNIQUE_CARRIER string, p double, q double, r double")
    got = {r["OP_UNIQUE_CARRIER"]: r["x"] for r in geometry.points(df, ["p", "q", "r"]).collect()}
    assert got["a"] == pytest.approx([-(0.5**0.5), -(0.5**0.5), 0.0]) and got["b"] == pytest.approx([0.5**0.5, 0.5**0.5, 0.0])
