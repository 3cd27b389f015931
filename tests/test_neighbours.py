"""The ball partition against brute force, with the pairs it lets meet counted."""

import numpy as np
import pytest

from aerolith.operators import cluster, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)


def clustered(n=2000, dims=16, groups=25, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims)) * 5
    return middles[np.arange(n) % groups] + rng.normal(size=(n, dims)) * 0.3


def apart(x):
    return np.sqrt(((x[:, None] - x) ** 2).sum(2))


@pytest.fixture(params=["clustered", "spread", "copies", "far"])
def x(request):
    rng = np.random.default_rng(2)
    copies = np.repeat(rng.normal(size=(1, 5)), 150, axis=0)
    return {"clustered": clustered(600), "spread": rng.normal(size=(400, 12)), "copies": np.vstack((copies, rng.normal(size=(200, 5)))), "far": clustered(300) + 1e4}[request.param]


def test_pairs_within_eps(spark, x):
    eps = float(np.quantile(apart(x), 0.03)) or 0.5
    i, j = np.nonzero(apart(x) <= eps)
    got = sorted(map(tuple, neighbours.eps_neighbours(frame(spark, x), eps).collect()))
    assert got == sorted((a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b)


def test_distance_to_the_kth(spark, x):
    expected = np.sort(apart(x) + np.where(np.eye(len(x)), np.inf, 0), axis=1)[:, 2]
    got = {r.id: r.distance for r in neighbours.nearest(frame(spark, x), 3).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(expected.tolist(), abs=1e-9)


def test_few_pairs_meet_on_clustered_points(spark):
    x = clustered()
    homes, visiting = neighbours.eps_cells(frame(spark, x), 1.0)
    h, v = (t.toPandas() for t in (homes, visiting))
    assert len(h) == len(x)
    found = met = 0
    for cell, left in h.groupby("cell"):
        right = v[v.cell == cell]
        i, _, m = neighbours.close_pairs(np.array(left.x.tolist()), np.array(right.x.tolist()), left.far.to_numpy(), right.far.to_numpy(), 1.0)
        found, met = found + len(i), met + m
    assert found == (apart(x) <= 1.0).sum() and met < len(x) ** 2 / 20


def test_blocks_of_large_cells(spark, monkeypatch):
    """Cells dealt in blocks of a few rows give the same pairs."""
    x = clustered(300)
    expected = sorted(map(tuple, neighbours.eps_neighbours(frame(spark, x), 1.0).collect()))
    monkeypatch.setattr(neighbours, "LEFT", 5)
    monkeypatch.setattr(neighbours, "RIGHT", 7)
    assert sorted(map(tuple, neighbours.eps_neighbours(frame(spark, x), 1.0, most=3).collect())) == expected


def test_few_points(spark):
    assert neighbours.eps_neighbours(frame(spark, np.zeros((0, 3))), 1.0).count() == 0
    assert neighbours.nearest(frame(spark, np.zeros((0, 3))), 2).count() == 0
    assert {r.id: r.distance for r in neighbours.nearest(frame(spark, [[0.0], [2.0]]), 2).collect()} == {0: None, 1: None}
    assert {r.id: r.distance for r in neighbours.nearest(frame(spark, [[0.0], [2.0]]), 1).collect()} == {0: 2.0, 1: 2.0}


def test_density_clusters_of_copies(spark):
    x = [[0.0]] * 40 + [[0.4], [5.0], [5.0], [9.0]]
    assert {r.id: r.cluster for r in cluster.dbscan(frame(spark, x), 0.5, 3).collect()} == {**dict.fromkeys(range(41), 0), 41: -1, 42: -1, 43: -1}
