"""Ward's linkage of points without structure: a grid of blocks, and only clusters without a partner ask again."""

import numpy as np
import pytest

from aerolith.operators import neighbours, ward
from test_ward import frame, plain


def test_linkage_without_structure(spark, monkeypatch):
    monkeypatch.setattr(ward, "SMALL", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(ward, "visits", lambda *_, **__: pytest.fail("clusters are copied to every cell"))
    asked, of = [], ward.partners_of
    monkeypatch.setattr(ward, "partners_of", lambda asking, clusters, known: (asked.append((asking.count(), clusters.count())), of(asking, clusters, known))[1])
    x = np.random.default_rng(8).normal(size=(130, 20))
    expected = plain(x)
    got = sorted((r.cost, r.a, r.b, r["size"]) for r in ward.linkage(frame(spark, x)).collect())
    assert [g[1:] for g in got] == [(a, b, s) for a, b, _, s in expected] and [g[0] for g in got] == pytest.approx([e[2] for e in expected])
    assert asked[0] == (130, 130) and len(asked) > 2 and all(a < n for a, n in asked[1:])
