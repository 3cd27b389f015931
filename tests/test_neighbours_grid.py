"""Points without structure: they meet in a grid of blocks with few copies, and pairs are counted, not listed."""

import numpy as np
import pyarrow as pa
import pytest

from aerolith.operators import cluster, neighbours
from test_neighbours import apart, clustered, frame


@pytest.fixture
def spread():
    return np.random.default_rng(4).normal(size=(500, 24)).astype(np.float32).astype(float)


@pytest.fixture
def no_visits(monkeypatch):
    """Many blocks, and no copy for each visited cell."""
    monkeypatch.setattr(neighbours, "BLOCK", 60)

    def visits(*_, **__):
        raise AssertionError("points are copied to every cell")

    monkeypatch.setattr(neighbours, "visits", visits)


def test_kth_distances(spark, spread, no_visits):
    expected = np.sort(apart(spread) + np.where(np.eye(len(spread)), np.inf, 0), axis=1)[:, 2]
    got = {r.id: r.distance for r in neighbours.nearest(frame(spark, spread), 3).collect()}
    assert [got[i] for i in range(len(spread))] == pytest.approx(expected.tolist(), abs=1e-9)


def test_degrees(spark, spread, no_visits):
    eps = float(np.quantile(apart(spread), 0.1))
    n = (apart(spread) <= eps).sum(1) - 1
    assert {r.id: r.n for r in neighbours.eps_degrees(frame(spark, spread), eps).collect()} == {i: k for i, k in enumerate(n.tolist()) if k}
    left, right = neighbours.met(neighbours.layout(frame(spark, spread), eps))
    copies = left.cogroup(right).applyInArrow(lambda a, b: pa.table({"n": [a.num_rows + b.num_rows]}), "n long")
    assert copies.groupBy().sum("n").first()[0] == 2 * neighbours.blocks(len(spread)) * len(spread)


def test_degrees_where_cells_spare(spark):
    x = clustered(600)
    at = neighbours.layout(frame(spark, x), 1.0)
    assert at.spares
    got = {r.id: r.n for r in neighbours.eps_degrees(frame(spark, x), 1.0, at).collect()}
    assert got == {i: k for i, k in enumerate(((apart(x) <= 1.0).sum(1) - 1).tolist()) if k}


def plain(x, eps, least):
    near = apart(x) <= eps
    core = near.sum(1) >= least
    out = np.where(core, np.arange(len(x)), -1)
    while True:
        low = np.where(near & core & core[:, None], np.where(core, out, len(x)), len(x)).min(1)
        new = np.where(core, np.minimum(out, low), -1)
        if (new == out).all():
            break
        out = new
    for i in np.flatnonzero(~core):
        around = np.flatnonzero(near[i] & core)
        out[i] = out[around[0]] if len(around) else -1
    return dict(enumerate(out.tolist()))


@pytest.mark.parametrize("share", [0.0001, 0.004, 0.02, 0.9])
def test_density_clusters(spark, spread, no_visits, share):
    eps = float(np.quantile(apart(spread) + np.where(np.eye(len(spread)), np.inf, 0), share))
    assert {r.id: r.cluster for r in cluster.dbscan(frame(spark, spread), eps, 3).collect()} == plain(spread, eps, 3)


def test_density_clusters_where_cells_spare(spark):
    x = clustered(400, groups=12)
    assert {r.id: r.cluster for r in cluster.dbscan(frame(spark, x), 1.0, 3).collect()} == plain(x, 1.0, 3)


def test_grid_of_radii(spark, spread, no_visits, monkeypatch):
    """All radii are counted in one pass over the pairs, none is listed."""
    radii = [float(np.quantile(apart(spread), q)) for q in (0.001, 0.02, 0.06, 0.5)]
    monkeypatch.setattr(neighbours, "eps_neighbours", lambda *_: pytest.fail("pairs are listed"))
    passes, of = [], neighbours.degrees
    monkeypatch.setattr(cluster, "degrees", lambda *a: (passes.append(1), of(*a))[1])
    got = cluster.dbscan_grid(frame(spark, spread), radii, 3)
    assert len(passes) == 1
    for (eps, found, noise, silhouette), radius in zip(got, radii):
        labels = list(plain(spread, radius, 3).values())
        assert (eps, found, noise) == (radius, len(set(labels) - {-1}), labels.count(-1)) and (silhouette > -1) == (found > 1)
