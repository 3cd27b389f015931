"""Silhouettes where every cluster may be the nearest: a grid of blocks, not a copy of a point for each cluster."""

import numpy as np
import pytest

from aerolith.operators import neighbours, silhouettes
from test_silhouettes import brute, frame


@pytest.mark.parametrize("k, block", [(3, 60), (40, 60), (12, 1000)])
def test_clusters_without_structure(spark, monkeypatch, k, block):
    """Large clusters lie in several blocks, small ones whole in one; copies, single points and noise among them."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(silhouettes, "candidates", lambda *_: pytest.fail("points are copied to every cluster"))
    rng = np.random.default_rng(7)
    x = np.vstack((rng.normal(size=(400, 10)), np.repeat(rng.normal(size=(1, 10)), 30, axis=0)))
    groups = np.concatenate((rng.integers(-1, k, 400), rng.integers(0, 2, 30)))
    groups[5] = k + 3
    monkeypatch.setattr(neighbours, "LEFT", 20)
    got = {r.id: r.silhouette for r in silhouettes.silhouettes(frame(spark, x, groups)).collect()}
    assert got == pytest.approx(brute(x, groups), abs=1e-9)
