"""Residuals as a whole, rates filled in from matrices, and summaries of the days asked for."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import ingest, metrics


def test_residual_density(spark):
    e = np.concatenate((np.random.default_rng(1).normal(size=200), [4.0]))
    rows = spark.createDataFrame([(float(v), 0.0) for v in e] + [(None, 1.0)], "pm10 double, predicted double")
    got = metrics.residual_density(rows).orderBy("bin").toPandas()
    n, edges = np.histogram(e, 50)
    assert got.n.tolist() == n.tolist() and got.low.tolist() == pytest.approx(edges[:-1].tolist())
    assert (got.density * (got.high - got.low)).sum() == pytest.approx(1.0)
    middle = (edges[:-1] + edges[1:]) / 2
    assert got.normal.tolist() == pytest.approx((np.exp(-(((middle - e.mean()) / e.std()) ** 2) / 2) / (e.std() * np.sqrt(2 * np.pi))).tolist())


def test_residual_density_of_equal_and_no_residuals(spark):
    rows = spark.createDataFrame([(2.0, 1.0)] * 3, "pm10 double, predicted double")
    got = metrics.residual_density(rows, bins=4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 3, 0] and got[0].low == 0.5 and got[2].normal is None and got[2].density == 4.0
    assert metrics.residual_density(rows.limit(0)).count() == 0


def test_rates_fill_only_what_is_absent(spark):
    whole = [[5, 1, 0, 0], [0, 2, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1]]
    rows = spark.createDataFrame([(1, whole, None), (2, whole, 0.5), (3, whole[:3], None), (4, [[0] * 4] * 4, None), (5, None, 0.1), (6, [[1] * 4] * 3 + [[1]], None)], "i int, matrix array<array<int>>, accuracy double")
    got = {r.i: (r.accuracy, r.severe, r.over, r.under) for r in metrics.completed(rows).collect()}
    none = (None,) * 4
    assert got == {1: (0.8, 0.1, 0.1, 0.1), 2: (0.5, 0.1, 0.1, 0.1), 3: none, 4: none, 5: (0.1, None, None, None), 6: none}


def test_days_without_readings_are_skipped_or_in_error(spark):
    at = lambda d: datetime.datetime(2025, 1, d, 5)
    rows = spark.createDataFrame([(1, at(1), 2.0), (2, at(1), None), (1, at(2), None), (1, at(3), 1.0)], "station_id long, ts timestamp, value double")
    days = spark.range(1, 7).select(F.make_date(F.lit(2025), F.lit(1), F.col("id").cast("int")).alias("day"))
    done = days.where("day(day) in (3, 5)").unionByName(days.where("day(day) = 5"))
    got = {r.day.day: (r.n_readings, r.outcome) for r in ingest.collection_summary(rows, days, done).collect()}
    assert got == {1: (2, "partial"), 2: (1, "error"), 3: (1, "ok"), 4: (0, "error"), 5: (0, "skipped"), 6: (0, "error")}
    assert {r.day.day: r.outcome for r in ingest.collection_summary(rows, days).collect()}[5] == "error"
    assert {r.day.day for r in ingest.collection_summary(rows).collect()} == {1, 2, 3}
