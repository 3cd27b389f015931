"""Silhouettes against brute force, with the pairs that meet counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import cluster, silhouettes


def frame(spark, x, groups):
    rows = [(i, list(map(float, v)), int(g)) for i, (v, g) in enumerate(zip(x, groups))]
    return spark.createDataFrame(rows, "id long, x array<double>, cluster long").repartition(4)


def brute(x, groups, squared=False):
    d = ((x[:, None] - x) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    out = {}
    for i, g in enumerate(groups):
        if g < 0:
            continue
        mine = groups == g
        if mine.sum() == 1:
            out[i] = 0.0
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, groups == o].mean() for o in set(groups.tolist()) - {g, -1})
        out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def spread(n=400, k=6, dims=5, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    groups = rng.integers(-1, k, n)
    return rng.normal(size=(k + 1, dims))[groups + 1] * 2 + rng.normal(size=(n, dims)) + offset, groups


@pytest.mark.parametrize("squared", [False, True])
@pytest.mark.parametrize("offset", [0.0, 1e4])
def test_equals_brute_force(spark, squared, offset):
    x, groups = spread(offset=offset)
    x, groups = np.vstack((x, np.repeat(x[:2], 60, axis=0), [[9.0 + offset] * 5])), np.concatenate((groups, [2] * 120, [7]))
    got = {r.id: r.silhouette for r in silhouettes.silhouettes(frame(spark, x, groups), squared).collect()}
    expected = brute(x, groups, squared)
    assert got == pytest.approx(expected, abs=1e-6)
    assert silhouettes.mean_silhouette(frame(spark, x, groups), squared) == pytest.approx(np.mean(list(expected.values())), abs=1e-6)


def test_centres_in_several_blocks_and_groups_of_few_rows(spark, monkeypatch):
    x, groups = spread(150, 9)
    monkeypatch.setattr(silhouettes, "MOST", 4)
    monkeypatch.setattr("aerolith.operators.neighbours.LEFT", 5)
    monkeypatch.setattr("aerolith.operators.neighbours.RIGHT", 7)
    for squared in (False, True):
        got = {r.id: r.silhouette for r in silhouettes.silhouettes(frame(spark, x, groups), squared).collect()}
        assert got == pytest.approx(brute(x, groups, squared), abs=1e-9)


def test_clusters_that_cannot_be_nearest_are_not_met(spark):
    rng = np.random.default_rng(5)
    groups = np.arange(1500) % 30
    x = rng.normal(size=(30, 8))[groups] * 10 + rng.normal(size=(1500, 8)) * 0.3
    rows = frame(spark, x, groups)
    found = silhouettes.candidates(silhouettes.kinds_of(rows), silhouettes.moments(rows))
    met = found.agg(F.sum("size")).first()[0]
    assert met < 1500**2 / 10  # own cluster and one other each would be a fifteenth


def test_few_clusters_and_no_points(spark):
    assert cluster.silhouette(frame(spark, np.zeros((0, 2)), np.zeros(0))) == -2.0
    assert cluster.silhouette(frame(spark, np.eye(3), [0, 0, -1])) == -2.0
    assert silhouettes.silhouettes(frame(spark, np.eye(2), [-1, -1])).count() == 0
    assert [r.silhouette for r in silhouettes.silhouettes(frame(spark, np.eye(2), [0, 0])).collect()] == [None, None]
    assert [r.silhouette for r in silhouettes.silhouettes(frame(spark, np.zeros((4, 2)), [0, 0, 1, 1])).collect()] == [0.0] * 4
