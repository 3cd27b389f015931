"""Selected quantiles against numpy, with brackets narrowed over several rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import quantiles

PROBS = (0.0, 0.25, 0.5, 0.999)


def check(spark, table, limit):
    rows = spark.createDataFrame([(g, *v) for g, v in table], "g string, a double, b double").repartition(3)
    got = quantiles.quantiles(rows, ["a", "b"], PROBS, limit=limit).collect()
    by = {r.g: r for r in quantiles.quantiles(rows, ["a", "b"], PROBS, by=["g"], limit=limit).collect()}
    assert len(got) == 1 and set(by) == {g for g, _ in table}
    for j, c in enumerate("ab"):
        for row, values in [(got[0], [v[j] for _, v in table])] + [(by[g], [v[j] for h, v in table if h == g]) for g in by]:
            known = [v for v in values if v is not None and not np.isnan(v)]
            assert row[c] == (pytest.approx(np.quantile(known, PROBS).tolist()) if known else None)


@pytest.mark.parametrize("limit", [1 << 16, 200])
def test_against_numpy(spark, limit):
    rng = np.random.default_rng(1)
    value = lambda: [None, float("nan"), 7.0, float(rng.normal()), float(rng.lognormal(0, 4)), float(rng.integers(5))][rng.integers(6)]
    table = [(rng.choice(["x", "y", None]), (value(), float(rng.normal()))) for _ in range(1500)]
    check(spark, [(None if g is None else str(g), v) for g, v in table] + [("z", (None, 1.0)), ("w", (3.0, None)), ("w", (5.0, None))], limit)


def test_many_copies_and_few_rows(spark):
    check(spark, [("x", (1.0, 2.0))] * 400 + [("x", (0.0, 5.0)), ("y", (2.0, -3.0))], 20)
    check(spark, [("x", (1.0, None))], 20)


def test_empty_and_rounds(spark):
    empty = spark.createDataFrame([], "a double")
    assert quantiles.overall(empty, ["a"], [0.5]) == {"a": None} and quantiles.overall(empty, [], [0.5]) == {}
    n = 100_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("a"))
    assert quantiles.quantiles(rows, ["a"], [0.3, 0.5], limit=1000).first()["a"] == pytest.approx([0.3 * (n - 1), 0.5 * (n - 1)])
