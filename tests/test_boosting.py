"""Softmax boosting: the loss falls, a plain version agrees, and odd labels take no part."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from aerolith.operators import boosting, models


def frame(spark, x, y):
    rows = spark.createDataFrame([(i, [float(a) for a in v], None if k is None else int(k)) for i, (v, k) in enumerate(zip(x, y))], "i long, x array<double>, class_id int")
    return rows.withColumn("features", array_to_vector("x"))


def data(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, (n, 2))
    return x, np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), (x[:, 0] // 3 + (x[:, 1] > 5)) % 3)


def stump(x, g, h):
    """The split of one feature that lowers the weighted squared error most, with its leaves' weighted means."""
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            means = [np.average(g[m], weights=h[m]) for m in (left, ~left)]
            loss = (h * (g - np.where(left, *means)) ** 2).sum()
            if best is None or loss < best[0]:
                best = loss, np.where(left, *means)
    return best[1]


def test_equals_a_plain_version(spark):
    x, y = data()
    add = boosting.fit_softmax(frame(spark, x, y), 3, maxIter=3, stepSize=0.5, maxDepth=1)
    raw = np.zeros((len(x), 3))
    for _ in range(3):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        h = np.maximum(2 * p * (1 - p), boosting.LEAST)
        raw = raw + 0.5 * np.stack([stump(x, ((y == k) - p[:, k]) / h[:, k], h[:, k]) for k in range(3)], axis=1)
    p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
    got = np.array([r.proba for r in add(frame(spark, x, y)).orderBy("i").collect()])
    assert got == pytest.approx(p, abs=1e-9)
    assert add.losses[-1] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())


def test_loss_falls_with_each_round(spark):
    x, y = data(300, 5)
    losses = boosting.fit_softmax(frame(spark, x, y), 3, maxIter=6, stepSize=0.3, maxDepth=3).losses
    assert losses[0] < np.log(3) and all(b < a for a, b in zip(losses, losses[1:]))


def test_absent_classes_and_odd_labels(spark):
    x, y = data(120, 7)
    add = boosting.fit_softmax(frame(spark, [*x, [0, 0], [1, 1]], [*y, None, 9]), 4, maxIter=2)
    clean = boosting.fit_softmax(frame(spark, x, y), 4, maxIter=2)
    probe = frame(spark, x[:5], y[:5])
    got = [r.proba for r in add(probe).collect()]
    assert [sum(p) for p in got] == pytest.approx([1.0] * 5) and all(0 < p[3] < 0.25 for p in got)
    assert np.array(got) == pytest.approx(np.array([r.proba for r in clean(probe).collect()]))
    with pytest.raises(ValueError):
        boosting.fit_softmax(probe.limit(0), 4)


def test_classifier_of_the_library(spark):
    x, y = data(200, 9)
    scored = models.fit_classifier(frame(spark, x, y), "boosted", 3, maxIter=3, maxDepth=3)(frame(spark, x, y))
    assert scored.columns == ["i", "x", "class_id", "features", "proba"]
    assert scored.agg(F.avg((F.array_position("proba", F.array_max("proba")) - 1 == F.col("class_id")).cast("double"))).first()[0] > 0.7
