"""Joint k-means against single fits and planted groups."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from cellmorph.operators import kmeans, ml


def frame(spark, points):
    return ml.vectors(spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "k long, v array<double>").repartition(3), "v")


def test_not_worse_than_single_fits(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.normal(size=(600, 5)) + rng.integers(0, 6, (600, 1)))
    found = kmeans.fit(rows, (2, 5), 12)
    for k in (2, 5):
        single = min(KMeans(k=k, seed=s, tol=1e-4, maxIter=100).fit(rows).summary.trainingCost for s in range(6))
        assert found[k][1] <= single * 1.005
        v = np.array([r["v"] for r in rows.select("v").collect()])
        d = ((v[:, None] - found[k][0]) ** 2).sum(2)
        assert found[k][1] == pytest.approx(d.min(1).sum(), rel=1e-3)


def test_planted_groups_any_partitioning(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [50, 0], [0, 50], [50, 50]])
    points = np.concatenate([c + rng.normal(size=(40, 2)) for c in centres])
    costs = set()
    for parts in (1, 4):
        marked, cost = ml.kmeans(frame(spark, points).repartition(parts), 4, 0, 8)
        groups = marked.groupBy(F.floor(F.col("k") / 40)).agg(F.count_distinct("cluster").alias("n")).collect()
        assert {r["n"] for r in groups} == {1} and marked.select("cluster").distinct().count() == 4
        costs.add(round(cost, 6))
    assert len(costs) == 1


def test_copies_few_points_and_none(spark):
    rows = frame(spark, [(1, 1)] * 30 + [(2, 2)] * 3)
    (centres, cost), = kmeans.fit(rows, (4,), 5).values()
    assert cost == pytest.approx(0) and sorted(map(tuple, centres)) == [(1, 1), (2, 2)]
    assert kmeans.fit(rows.limit(0), (2,), 3)[2][1] == 0.0
    best = ml.best_k(frame(spark, [(i % 3 * 100, j) for j in range(10) for i in range(3)]), "k", (2, 3, 4), n_init=6).first()
    assert best["k"] == 3


def test_silhouettes_are_of_all_rows(spark, monkeypatch):
    """Against every pair, over more rows than the sample of 1000 that was taken once, in blocks that differ in size."""
    monkeypatch.setattr(ml, "BLOCK", 100)
    rng = np.random.default_rng(5)
    points = np.concatenate([[[0, 0]] * 3, [[60, 60]], rng.normal(size=(1200, 2)), rng.normal(size=(300, 2)) + 4])
    rows = frame(spark, points).repartition(3)
    three = np.array([0 if i < 3 else 1 if i == 3 else 2 for i in range(len(points))])
    two = (points[:, 0] > 2).astype(int)
    marked = rows.join(spark.createDataFrame([(i, int(a), int(b), 0) for i, (a, b) in enumerate(zip(two, three, strict=True))], "k long, two int, three int, one int"), "k")
    d = np.sqrt(((points[:, None] - points) ** 2).sum(2))

    def by_hand(label):
        values = []
        for i, own in enumerate(label):
            inner = d[i][label == own].sum() / max((label == own).sum() - 1, 1)
            other = min(d[i][label == x].mean() for x in set(label) - {own})
            values.append(0.0 if (label == own).sum() == 1 else (other - inner) / max(inner, other))
        return float(np.mean(values))

    found = ml.whole_silhouettes(marked, "features", ["two", "three", "one"], [2, 3, 1])
    assert found[1] == (None, 0)
    for k, label in ((2, two), (3, three)):
        assert found[k] == (pytest.approx(by_hand(label)), len(points))
    assert ml.whole_silhouettes(marked.limit(0), "features", ["two"], [2]) == {2: (None, 0)}


def test_best_k_counts_every_row(spark, monkeypatch):
    """The last rows, which a sample by a hash would mostly miss, make a cluster of their own."""
    seen = []
    real = ml.whole_silhouettes
    monkeypatch.setattr(ml, "whole_silhouettes", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = frame(spark, np.concatenate([np.random.default_rng(1).normal(size=(1500, 2)) + c for c in (0, 50)]))
    best = ml.best_k(rows, "k", (2, 3), n_init=3).first()
    assert best["k"] == 2 and {n for _, n in seen[0].values()} == {3000}
