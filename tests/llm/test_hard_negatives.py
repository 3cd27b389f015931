"""Hard negatives against brute force."""

import numpy as np
import pytest

from aerolith.llm import hard_negatives


def brute(rows, every=100, k=5, share=80, scale=256):
    vectors = {}
    dim = max((len(r[1]) for r in rows if r[1] is not None), default=0)
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = np.zeros(dim, np.int64)
        v[: len(x)] = np.floor(scale * np.array(x, np.float64))
        vectors[i] = (label, v)
    ids = np.array(sorted(vectors))
    m, labels = np.array([vectors[i][1] for i in ids]), np.array([vectors[i][0] for i in ids])
    out = []
    for at, i in enumerate(ids):
        if i % every:
            continue
        s = m @ m[at]
        order = np.lexsort((ids, -s))
        order = order[order != at]
        for p in order[labels[order] == labels[at]][:k]:
            fits = [q for q in order[labels[order] != labels[at]] if share * s[p] <= 100 * s[q] <= 100 * s[p]][:k]
            out += [(int(i), int(ids[p]), r + 1, int(ids[q]), int(s[p]), int(s[q])) for r, q in enumerate(fits)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(spark, data):
    odd = [(100000, [0.1, None], 1), (100100, [float("nan")] * 64, 2), (None, [0.1] * 64, 3), (100200, None, 4), (100300, [0.2] * 64, None), *((100400 + i, [0.5] * 64, i % 2) for i in range(12)), (100401, [0.5] * 64, 1), (100500, [0.3, -0.2], 3), (100600, [], 5), (100700, [0.0] * 64, 6), (100800, [0.4] * 64, 77), (-100, [-0.3] * 64, -3)]
    return [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()] + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "z") for r in rows], "vec_id long, embedding array<float>, label int, cluster int, bound double, place string").repartition(5)


@pytest.mark.parametrize("small", [{}, {"cluster": 2, "page": 40, "first": 1, "group": 2}])
def test_equals_brute_force(spark, rows, small):
    got = hard_negatives.hard_negatives(frame(spark, rows), **small)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_clusters_skip_pages(spark, monkeypatch):
    """Well apart groups of vectors: the walk stops long before the end of the list, and the results stay those of brute force."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(8, 16)) * 3
    rows = [(i, [float(x) for x in middles[i % 8] + rng.normal(size=16) * 0.2], int(rng.integers(4))) for i in range(1600)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(frame(spark, rows), every=25, cluster=8, page=100, first=1).collect())) == brute(rows, 25)
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    norms = np.sqrt((v * v).sum(axis=1).astype(float))
    centres = hard_negatives.centres_of(v[::25].astype(float), 8)
    far = hard_negatives.angles(v.astype(float), norms, centres)
    members = np.flatnonzero(far[::25].argmin(axis=1) == 0) * 25
    bound = norms * np.cos(np.maximum(far[:, 0] - far[members, 0].max(), 0))
    met = []
    real = hard_negatives.exact
    monkeypatch.setattr(hard_negatives, "exact", lambda a, b: met.append(len(a) * len(b)) or real(a, b))
    monkeypatch.setattr(hard_negatives, "STEP", 50)
    labels, ids = np.array([r[2] for r in rows]), np.arange(1600)
    open_range = np.full((len(members), 1), hard_negatives.LEAST), np.full((len(members), 1), hard_negatives.MOST)
    hard_negatives.walk(members, labels[members], v[members], norms[members], *open_range, ids, labels, v, bound, 5, True, np.full(len(members), 1e-3))
    assert sum(met) < len(members) * 1600 / 4


def test_empty(spark, rows):
    assert hard_negatives.hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, rows[:1])).count() == 0
