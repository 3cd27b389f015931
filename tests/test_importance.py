"""Permuted copies hold the same values, and one scoring job gives what copies scored one by one give."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import models

REPEATS = 3


def rows_of(spark, n=300):
    rng = np.random.default_rng(4)
    made = [(i % 5, datetime.date(2025, 1, 1) + datetime.timedelta(i // 5), float(rng.normal()), float(rng.normal()) if i % 7 else None, ["a", "b"][i % 2], int(i % 4)) for i in range(n)]
    return spark.createDataFrame([(*r, r[2] * 3 + (r[3] or 0.0)) for r in made], "station_id long, day date, x double, y double, kind string, class_id int, pm10 double").repartition(3)


def test_copies_are_permutations_of_one_feature(spark):
    rows, features = rows_of(spark), ["x", "y", "kind"]
    copies = models.permuted_copies(rows, features, REPEATS, bucket=64).toPandas()
    assert sorted(copies["_copy"].unique()) == list(range(len(features) * REPEATS + 1))
    base = copies[copies["_copy"] == 0].set_index(["station_id", "day"]).sort_index()
    assert base[["x", "y", "kind"]].equals(rows.toPandas().set_index(["station_id", "day"]).sort_index()[["x", "y", "kind"]])
    seen = set()
    for c in range(1, len(features) * REPEATS + 1):
        one, f = copies[copies["_copy"] == c].set_index(["station_id", "day"]).sort_index(), features[(c - 1) // REPEATS]
        assert sorted(map(str, one[f])) == sorted(map(str, base[f]))
        assert all(one[o].equals(base[o]) for o in features if o != f)
        assert (one[f].astype(str) != base[f].astype(str)).mean() > 0.3
        seen.add((f, tuple(map(str, one[f]))))
    assert len(seen) == len(features) * REPEATS  # every repeat is another permutation


def test_drops_equal_those_of_single_copies(spark):
    rows, features = rows_of(spark), ["x", "y"]
    add = lambda df: df.withColumn("predicted", F.col("x") * 3 + F.coalesce("y", F.lit(0.0)))
    found = models.permutation_importance(rows, features, add, models.negative_rmse_by, REPEATS)
    copies = models.permuted_copies(rows, features, REPEATS)
    score = lambda c: models.negative_rmse(add(copies.where(F.col("_copy") == c)))
    assert score(0) == 0.0
    expected = {f: [-score(i * REPEATS + r + 1) for r in range(REPEATS)] for i, f in enumerate(features)}
    assert [f for f, _, _ in found] == ["x", "y"]  # three times the spread
    assert {f: (m, s) for f, m, s in found} == {f: (pytest.approx(np.mean(d)), pytest.approx(np.std(d))) for f, d in expected.items()}


def test_f1_form_and_one_job(spark):
    rows = rows_of(spark)
    hit = lambda k: F.when(F.col("truth") == k, 1.0).otherwise(0.0)
    rows = rows.withColumn("truth", F.col("class_id").cast("double"))
    calls = []

    def add(df):
        calls.append(1)
        return df.withColumn("proba", F.array(*map(hit, range(4))))

    found = models.permutation_importance(rows, ["truth", "x"], add, models.f1_macro_by, REPEATS)
    assert len(calls) == 1 and found[0][0] == "truth" and 0.5 < found[0][1] <= 1 and found[1][1:] == (0.0, 0.0)
    assert models.permutation_importance(rows.limit(0), ["x"], lambda df: df.withColumn("predicted", F.lit(1.0)), models.negative_rmse_by) == []


def test_rows_are_shuffled_before_they_are_copied(spark):
    plan = models.permuted_copies(rows_of(spark), ["x", "y"], REPEATS, bucket=64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
