"""Seeding by oversampling, and rounds with bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.operators import seeding
from mixframe.operators.fitting import lloyd


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5)) * 20
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    return rows.repartition(6).cache(), x


def test_bounds_give_the_same_centres_with_fewer_distances(points):
    rows, x = points
    start = x[:12]
    plain, bounded = lloyd(rows, "v", start, 8), seeding.lloyd_bounded(rows, "v", start, 8)
    assert np.allclose(bounded.clustering.centres, plain.centres, atol=1e-9)
    assert bounded.clustering.cost == pytest.approx(plain.cost)
    assert bounded.distances < 0.6 * 8 * len(x) * 12


@pytest.mark.parametrize("k", [1, 2])
def test_bounds_with_few_centres(points, k):
    rows, x = points
    found = seeding.lloyd_bounded(rows, "v", x[:k], 4).clustering
    assert np.allclose(found.centres, lloyd(rows, "v", x[:k], 4).centres)


def test_bounds_with_copies_and_empty(spark):
    same = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    found = seeding.lloyd_bounded(same, "v", np.array([[1.0, 2.0], [1.0, 2.0]]), 3)
    assert np.allclose(found.clustering.centres, [[1.0, 2.0]] * 2) and found.clustering.cost == 0.0
    none = seeding.lloyd_bounded(same.limit(0), "v", np.zeros((2, 2)), 3)
    assert np.array_equal(none.clustering.centres, np.zeros((2, 2))) and none.distances == 0


def test_seeding_does_not_depend_on_partitions(points):
    rows, _ = points
    one = seeding.seeded_centres(rows, "id", "v", 12, restarts=2)
    other = seeding.seeded_centres(rows.repartition(2), "id", "v", 12, restarts=2)
    assert all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))
    assert not np.array_equal(one[0], one[1])


def test_seeding_finds_the_clusters(points):
    rows, x = points
    found = seeding.kmeans_seeded(rows, "id", "v", 12, restarts=2, max_iter=10)
    assert found.cost < 1.1 * len(x) * 5
    again = lloyd(rows, "v", found.centres, 1)
    assert again.cost <= found.cost * (1 + 1e-9)


def test_candidates_by_brute_force(spark, points):
    rows, x = points
    found, weights = seeding.candidates(rows, "id", "v", 4, [0, 5], passes=2)
    for c, w, seed in zip(found, weights, [0, 5], strict=True):
        draws = {
            turn: np.array([r[0] for r in rows.orderBy("id").select(seeding.draw_of("id", turn, seed)).collect()]) for turn in range(3)
        }
        expected = x[[int(draws[0].argmin())]]
        for turn in (1, 2):
            cost = ((x[:, None] - expected[None]) ** 2).sum(axis=2).min(axis=1)
            expected = np.vstack([expected, x[draws[turn] * cost.sum() < 8 * cost]])
        assert np.array_equal(c, expected) and w.sum() == len(x)
        near = ((x[:, None] - expected[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.array_equal(w, np.bincount(near, minlength=len(c)))


def test_reduction_and_empty(spark):
    pick = seeding.weighted_reduction(np.array([[0.0], [1.0], [10.0]]), np.array([1.0, 5.0, 1.0]), 2)
    assert pick.tolist() == [[1.0], [10.0]]
    assert seeding.weighted_reduction(np.array([[3.0]]), np.array([4.0]), 3).tolist() == [[3.0]] * 3
    with pytest.raises(ValueError, match="no rows"):
        seeding.candidates(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 2, [0])
