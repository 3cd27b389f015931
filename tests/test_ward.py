"""Ward's linkage against plain merging of one pair after the other, in one task and in distributed rounds."""

import numpy as np
import pytest

from aerolith.operators import cluster, ward


def plain(x):
    """(a, b, cost, size) of each merge in turn; ties by the smaller ids."""
    names, means, sizes, out = list(range(len(x))), [np.array(v, float) for v in x], [1.0] * len(x), []
    while len(names) > 1:
        m, s = np.array(means), np.array(sizes)
        gap = ((m[:, None] - m[None]) ** 2).sum(-1) * s[:, None] * s[None] / (s[:, None] + s[None])
        gap[np.tril_indices(len(m))] = np.inf
        a, b = np.unravel_index(np.argmin(gap), gap.shape)
        out.append((names[a], names[b], gap[a, b], int(sizes[a] + sizes[b])))
        means[a] = (means[a] * sizes[a] + means[b] * sizes[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        del means[b], sizes[b], names[b]
    return out


def labels(merges, n, k):
    into = {b: a for a, b, _, _ in merges[: n - k]}
    out = []
    for i in range(n):
        while i in into:
            i = into[i]
        out.append(i)
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)


@pytest.mark.parametrize("small", [2048, 60])
@pytest.mark.parametrize("seed, n", [(1, 40), (2, 130)])
def test_linkage_and_cuts(spark, monkeypatch, small, seed, n):
    monkeypatch.setattr(ward, "SMALL", small)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) + rng.integers(0, 4, size=(n, 1)) * 3
    expected = plain(x)
    got = sorted((r.cost, r.a, r.b, r["size"]) for r in ward.linkage(frame(spark, x)).collect())
    assert [g[1:] for g in got] == [(a, b, s) for a, b, _, s in expected] and [g[0] for g in got] == pytest.approx([e[2] for e in expected])
    if n == 40 or small == 2048:
        for k, labelled in ward.cuts(frame(spark, x), [2, 5]).items():
            assert {r.id: r.cluster for r in labelled.collect()} == dict(enumerate(labels(expected, n, k)))


def test_copies_and_few_points(spark, monkeypatch):
    monkeypatch.setattr(ward, "SMALL", 2)
    got = {r.id: r.cluster for r in cluster.ward(frame(spark, [[0.0], [0.0], [0.0], [5.0], [5.2]]), 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert {r.id: r.cluster for r in cluster.ward(frame(spark, [[1.0], [2.0]]), 3).collect()} == {0: 0, 1: 1}
    assert cluster.ward(frame(spark, np.zeros((0, 2))), 2).count() == 0
