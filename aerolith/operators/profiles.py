"""Station profiles, scaling, and the measures of clusterings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators.quantiles import overall, quantiles

FEATURES = ("pm10_mean", "critical_share", "winter_ratio", "stagnation_mean", "dist_industrial_km", "no2_mean", "altitude", "wind_mean")
METADATA = ("station_name", "province", "municipality", "lat", "lng")


def station_profiles(panel: DataFrame) -> DataFrame:
    """One row a station: target mean, share of critical days, winter to summer ratio, means, first known metadata."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("day"))).alias(c)
    in_season = lambda s: F.avg(F.when(F.col("season") == s, F.col("pm10")))
    critical = F.coalesce(F.col("alert_class").isin("arancio", "rosso"), F.lit(False))
    return panel.groupBy("station_id").agg(
        *map(known, METADATA), F.avg("pm10").alias("pm10_mean"), F.avg(critical.cast("double")).alias("critical_share"), (in_season("winter") / in_season("summer")).alias("winter_ratio"),
        F.avg("stagnation_index").alias("stagnation_mean"), F.avg("no2_mean").alias("no2_mean"), F.avg("wind_speed_mean").alias("wind_mean"), known("altitude"), known("dist_industrial_km"),
    )


def impute_by_province(profiles: DataFrame, columns: Sequence[str] = ("altitude", "no2_mean")) -> DataFrame:
    """Nulls take the median of the province, else that of all. A ValueError if a column has no value at all."""
    middle = overall(profiles, columns, [0.5])
    if empty := [c for c in columns if middle[c] is None]:
        raise ValueError(f"no station has {', '.join(empty)}")
    medians = quantiles(profiles, columns, [0.5], by=["province"])
    medians = medians.select(F.col("province").alias("_province"), *(F.get(c, F.lit(0)).alias(f"_{c}") for c in columns))
    joined = profiles.join(medians, F.col("province").eqNullSafe(F.col("_province")))
    return joined.withColumns({c: F.coalesce(c, f"_{c}", F.lit(middle[c][0])) for c in columns}).select(*profiles.columns)


def robust_scaled(profiles: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """(x - median) / interquartile range; a range of zero counts as one."""
    row = overall(profiles, columns, (0.25, 0.5, 0.75))
    return profiles.withColumns({c: (F.col(c) - row[c][1]) / ((row[c][2] - row[c][0]) or 1.0) for c in columns})


def cluster_scores(points: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """inertia, calinski_harabasz and davies_bouldin of labelled points (array column), from sums over clusters."""
    long = points.select(label, F.posexplode(features).alias("i", "x"))
    sums = long.groupBy(label, "i").agg(F.avg("x").alias("centre"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n"))
    everything = long.groupBy("i").agg(F.avg("x").alias("mean"))
    parts = sums.join(F.broadcast(everything), "i").agg(F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * (F.col("centre") - F.col("mean")) ** 2).alias("between"))
    n, k = points.count(), sums.select(label).distinct().count()
    centres = sums.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "centre")))["centre"].alias("centre"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    spread = points.join(F.broadcast(centres), label).groupBy(label).agg(F.avg(apart(F.col(features), F.col("centre"))).alias("spread"))
    c = centres.join(spread, label)
    other = c.select(F.col(label).alias("_other"), F.col("centre").alias("_centre"), F.col("spread").alias("_spread"))
    worst = c.join(other, F.col(label) != F.col("_other")).groupBy(label).agg(F.max((F.col("spread") + F.col("_spread")) / apart(F.col("centre"), F.col("_centre"))).alias("r"))
    return parts.join(worst.agg(F.avg("r").alias("davies_bouldin"))).select(F.col("within").alias("inertia"), (F.col("between") / (k - 1) / (F.col("within") / (n - k))).alias("calinski_harabasz"), "davies_bouldin")


def contingency(rows: DataFrame, truth: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("t"), F.col(label).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def external_validation(rows: DataFrame, truth: str, label: str) -> DataFrame:
    """ari, homogeneity, completeness, v_measure of clusters against known groups."""
    table = contingency(rows, truth, label)
    by_t, by_c = table.groupBy("t").agg(F.sum("n").alias("n")), table.groupBy("c").agg(F.sum("n").alias("n"))
    pairs, h = (lambda n: n * (n - 1) / 2), (lambda n: F.sum(n * F.log(n)))
    joint = table.agg(F.sum(pairs(F.col("n"))).alias("p"), h(F.col("n")).alias("h"), F.sum("n").alias("n"))
    true = by_t.agg(F.sum(pairs(F.col("n"))).alias("pt"), h(F.col("n")).alias("ht"))
    found = by_c.agg(F.sum(pairs(F.col("n"))).alias("pc"), h(F.col("n")).alias("hc"))
    one = joint.join(true).join(found)  # one row each
    n, expected = F.col("n"), F.col("pt") * F.col("pc") / pairs(F.col("n"))
    h_t, h_c, h_tc = (F.log(n) - F.col(x) / n for x in ("ht", "hc", "h"))
    one = one.select(F.when((F.col("pt") + F.col("pc")) / 2 == expected, 1.0).otherwise((F.col("p") - expected) / ((F.col("pt") + F.col("pc")) / 2 - expected)).alias("ari"),
                     F.when(h_t < 1e-12, 1.0).otherwise(1 - (h_tc - h_c) / h_t).alias("homogeneity"), F.when(h_c < 1e-12, 1.0).otherwise(1 - (h_tc - h_t) / h_c).alias("completeness"))
    a, b = F.col("homogeneity"), F.col("completeness")
    return one.withColumn("v_measure", F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b)))


def dominant_class(rows: DataFrame, group: str = "station_id", label: str = "alert_class") -> DataFrame:
    """The most common class of each group, ties to the lower class in the order of C.LABELS, other labels behind them; and its share."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    top = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc_nulls_last(C.class_id_of(label)), label))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumns({"_top": top, "share": share}).where("_top = 1").drop("_top")


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """h (tie-corrected) and degrees of freedom. Ranks come from counts of distinct values, in range partitions."""
    values = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(values, "v", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = rows.join(ranked.select(F.col("v").alias(value), "rank"), value).groupBy(group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("m"))
    ties = ranked.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"), F.sum("n").cast("double").alias("n"))
    one = sums.agg(F.sum(F.col("r") ** 2 / F.col("m")).alias("s"), F.count(F.lit(1)).alias("groups")).join(ties)
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    return one.select((h / (1 - F.col("ties") / (F.col("n") ** 3 - F.col("n")))).alias("h"), (F.col("groups") - 1).alias("df"))


def running(rows: DataFrame, order: str, count: str, buckets: int = 256) -> DataFrame:
    """rows with `before`: the sum of count over smaller values of order, by range buckets and their offsets."""
    edges = rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001) if not rows.isEmpty() else []
    marks = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*map(F.lit, marks)) if marks else F.array(F.lit(0.0)), lambda e: F.col(order) > e))
    dealt = rows.withColumn("_bucket", bucket)
    sums = dealt.groupBy("_bucket").agg(F.sum(count).alias("_n"))
    starts = sums.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"))  # a row a bucket
    within = F.sum(count).over(Window.partitionBy("_bucket").orderBy(order)) - F.col(count)
    return dealt.withColumn("_within", within).join(F.broadcast(starts), "_bucket").withColumn("before", F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-squared distribution."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half / math.pi) * 2
    for i in range(3, df + 1, 2):
        total += term
        term *= half / (i / 2)
    return total


def neighbour_distances(points: DataFrame, k: int = 3, id_col: str = "vec_id", features: str = "features") -> DataFrame:
    """Distance of each point to its k-th neighbour, by the ball partition."""
    from aerolith.operators.neighbours import nearest

    return nearest(points.select(F.col(id_col).alias("id"), F.col(features).alias("x")), k)


def cluster_means(rows: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in columns))


def cluster_summary(rows: DataFrame) -> DataFrame:
    """Label (High for the largest mean target, else Low), means, and stations by name, of each cluster."""
    out = rows.groupBy("cluster").agg(F.avg("pm10_mean").alias("pm10_mean"), F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("station_name"))).alias("stations"))
    return out.withColumn("label", F.when(F.col("pm10_mean") == F.max("pm10_mean").over(Window.partitionBy(F.lit(1))), "High").otherwise("Low"))  # a row a cluster
