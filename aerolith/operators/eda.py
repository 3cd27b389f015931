"""Exploratory statistics, each in one or two passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions.columns import LABELS
from aerolith.operators.quantiles import overall, quantiles
from aerolith.sources.scratch import written


def missing_report(rows: DataFrame) -> DataFrame:
    """column_name, present, missing, missing_pct, sparse."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in rows.columns))
    long = counts.unpivot(["_n"], rows.columns, "column_name", "present")
    share = F.round(100 * (F.col("_n") - F.col("present")) / F.col("_n"), 4)
    return long.select("column_name", "present", (F.col("_n") - F.col("present")).alias("missing"), share.alias("missing_pct"), (share > 50).alias("sparse"))


def station_coverage(rows: DataFrame) -> DataFrame:
    n = rows.select("day").distinct().count()
    pct = F.round(100 * F.col("n_days") / n, 1)
    return rows.groupBy("station_id").agg(F.countDistinct("day").alias("n_days")).withColumns({"pct": pct, "low": pct < 50})


def class_distribution(rows: DataFrame, labels: Sequence[str] | None = LABELS) -> DataFrame:
    """alert_class, n, pct of all labels, absent ones too (without labels: of the classes that occur); balance is the rarest over the most common class."""
    counts = rows.groupBy("alert_class").agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        names = rows.sparkSession.createDataFrame([(x,) for x in labels], "alert_class string")
        counts = names.join(counts, "alert_class", "left").select("alert_class", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row a label
    return counts.select("alert_class", "n", (100 * F.col("n") / F.sum("n").over(w)).alias("pct"), (F.min("n").over(w) / F.max("n").over(w)).alias("balance"))


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, quartiles, and bias-corrected skewness and kurtosis of each column."""
    quarters, stats = overall(rows, columns, (0.25, 0.5, 0.75)), []
    for c in columns:
        n, g1, g2 = F.count(c).cast("double"), F.skewness(c), F.kurtosis(c)
        quarter = [F.lit(q).cast("double") for q in quarters[c] or (None, None, None)]
        stats.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *(q.alias(a) for q, a in zip(quarter, ("q25", "q50", "q75"))), F.max(c).cast("double").alias("max"),
                              (F.sqrt(n * (n - 1)) / (n - 2) * g1).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis")))
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def correlations(rows: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """column_name, r with the target over rows where both are known, n, slope and intercept of the line."""
    parts = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c).cast("double")), F.when(both, F.col(target).cast("double"))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.corr(x, y).alias("r"), F.count_if(both).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")))
    return rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def top_correlations(rows: DataFrame, target: str, columns: Sequence[str], n: int = 10) -> DataFrame:
    """The n columns of largest absolute r; r equal to nine places is a tie, which goes by name."""
    return correlations(rows, target, columns).where("r is not null and not isnan(r)").orderBy(F.desc(F.round(F.abs("r"), 9)), "column_name").limit(n)


def correlation_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for every pair, pairwise complete, in one pass."""
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            parts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias("r")))
    half = rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))
    return half.unionByName(half.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def missing_by_station(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy("station_id").agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def histogram(rows: DataFrame, column: str, bins: int = 50, ends: tuple[float, float] | None = None) -> DataFrame:
    """bin (from 0), n between the smallest and largest value (ends, where they are known); the last bin is closed.

    Without ends the values are written once: a mean evaluated a second time may be added up in another order and fall below the smallest.
    """
    if ends is None:
        rows = written(rows.select(column).where(F.col(column).isNotNull()), "values")
    lo, hi = ends or rows.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return rows.sparkSession.createDataFrame([], "bin int, n long")
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(rows: DataFrame, column: str, points: int = 100) -> DataFrame:
    """x, density: a Gaussian kernel estimate on a grid, from a fine histogram; bandwidth by Scott's rule."""
    lo, hi, std, n = rows.agg(F.min(column), F.max(column), F.stddev_samp(column), F.count(column)).first()
    if not n or not std:
        return rows.sparkSession.createDataFrame([], "x double, density double")
    h, bins = std * n**-0.2, 1024
    centres = histogram(rows, column, bins, (lo, hi)).select((F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / bins)).alias("c"), "n")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo - 3 * h + i * ((hi - lo + 6 * h) / (points - 1)))).alias("x")
    z = (F.col("x") - F.col("c")) / h
    return centres.select("c", "n", grid).groupBy("x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / (n * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def box_stats(rows: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles of a group, and its smallest and largest value within 1.5 interquartile ranges of them."""
    q = quantiles(rows.where(F.col(column).isNotNull()), [column], (0.25, 0.5, 0.75), by=[group]).withColumnRenamed(column, "q")
    q = q.select(group, *(F.get("q", F.lit(i)).alias(a) for i, a in enumerate(("q25", "q50", "q75"))))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = rows.join(F.broadcast(q), group).where((F.col(column) >= F.col("q25") - reach) & (F.col(column) <= F.col("q75") + reach))  # a row a group
    return q.join(inside.groupBy(group).agg(F.min(column).alias("low"), F.max(column).alias("high")), group)


def series(rows: DataFrame, key, name: str) -> DataFrame:
    """Mean and deviation of the target across stations by day or month."""
    return rows.where("pm10 is not null").groupBy(key.alias(name)).agg(F.avg("pm10").alias("mean"), F.stddev_samp("pm10").alias("std"), F.count(F.lit(1)).alias("n"))


def run_summary(rows: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("alert_class") == x).alias(f"n_{x}") for x in LABELS]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), *counts)
