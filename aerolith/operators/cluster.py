"""Clusterings: KMeans grid, Ward merges, density clusters, PCA, and the choice among them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.neighbours import Layout, degrees, layout, least_neighbours
from aerolith.operators.silhouettes import mean_silhouette as silhouette
from aerolith.operators.ward import cuts
from aerolith.sources.scratch import written


def kmeans(points: DataFrame, k: int, seeds: int = 10) -> tuple[DataFrame, float]:
    """points (id, x) with cluster, and the inertia, of the best of several starts."""
    rows = points.withColumn("features", array_to_vector("x"))
    with ThreadPoolExecutor(min(4, seeds)) as pool:
        models = list(pool.map(lambda s: KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster").fit(rows), range(seeds)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("features").withColumn("cluster", F.col("cluster").cast("long")), best.summary.trainingCost


def sizes(labelled: DataFrame) -> list[int]:
    """Points of each cluster but noise: a number a cluster."""
    return [r[1] for r in sorted(labelled.where("cluster >= 0").groupBy("cluster").count().collect())]


def kmeans_grid(points: DataFrame, ks: Sequence[int] = range(2, 9), seeds: int = 10) -> list[tuple[int, float, float, list[int]]]:
    """k, inertia, silhouette, sizes."""
    made = [(k, *kmeans(points, k, seeds)) for k in ks]
    return [(k, cost, silhouette(labelled), sizes(labelled)) for k, labelled, cost in made]


def ward_grid(points: DataFrame, ks: Sequence[int] = range(2, 9)) -> list[tuple[int, float, list[int]]]:
    """k, silhouette, sizes; all from one linkage."""
    made = [(k, written(labelled, "ward")) for k, labelled in cuts(points, list(ks)).items()]
    return [(k, silhouette(labelled), sizes(labelled)) for k, labelled in made]


def dbscan_grid(points: DataFrame, eps: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5), min_samples: int = 3) -> list[tuple[float, int, int, float]]:
    """eps, clusters, noise points, silhouette without noise."""
    out = []
    kinds = kinds_of(points)
    if kinds.isEmpty():
        return [(e, 0, 0, -2.0) for e in eps]
    at = layout(kinds, max(eps))
    around = written(degrees(kinds, at, list(eps)), "degrees")
    for i, e in enumerate(eps):
        of = around.select("id", F.get("n", F.lit(i)).alias("others"))
        labelled = written(density(points, kinds, at._replace(eps=e), of, min_samples), "dbscan")
        noise, found = labelled.agg(F.count_if(F.col("cluster") < 0), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster")))).first()
        out.append((e, found, noise, silhouette(labelled)))
    return out


def ward(points: DataFrame, k: int) -> DataFrame:
    """points with cluster of k clusters by Ward's merges, exact at any size."""
    return cuts(points, [k])[k]


def dbscan(points: DataFrame, eps: float, min_samples: int = 3) -> DataFrame:
    """points with cluster: the smallest core id of its component, by id; a border point joins its lowest core; noise is -1.

    Equal points are one point of that weight throughout, so many copies make no pairs.
    """
    kinds = kinds_of(points)
    if kinds.isEmpty():
        return points.select("id", "x", F.lit(-1).cast("long").alias("cluster"))
    at = layout(kinds, eps)
    return density(points, kinds, at, degrees(kinds, at, [eps]).select("id", F.get("n", F.lit(0)).alias("others")), min_samples)


def kinds_of(points: DataFrame) -> DataFrame:
    """x, id (the smallest), w: each distinct point and how often it occurs."""
    return written(points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "kinds")


def density(points: DataFrame, kinds: DataFrame, at: Layout, around: DataFrame, min_samples: int) -> DataFrame:
    """points with cluster, from distinct points and the number of others around each (id, others)."""
    core = written(kinds.join(around, "id", "left").where(F.col("w") + F.coalesce("others", F.lit(0)) >= min_samples).select("id"), "core")
    # Pairs are not listed: each group names the smallest core that a point meets, then one core of another component, until there is none.
    found = written(least_neighbours(at, None, core), "found")
    border = found.join(core, "id", "left_anti").groupBy("id").agg(F.min("b").alias("b"))
    links, labels = found.join(core, "id", "left_semi"), core.withColumn("root", F.col("id"))
    while not links.isEmpty():
        labels = spread(labels, links)
        largest = labels.groupBy("root").count().orderBy(F.desc("count"), "root").first()["root"]
        others = labels.where(F.col("root") != largest)
        if others.isEmpty():
            break
        links = written(least_neighbours(at, others, labels, "root"), "links")
    border = border.join(labels.select(F.col("id").alias("b"), "root"), "b").select("id", F.col("root").alias("edge"))
    named = kinds.join(labels, "id", "left").join(border, "id", "left").select("x", F.coalesce("root", "edge", F.lit(-1)).alias("cluster"))
    return points.select("id", "x").join(named, "x")


def spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, root) joined further by links (id, b): the smallest root of each component."""
    roots = labels.select("id", "root")
    ends = links.join(roots, "id").withColumnRenamed("root", "p").join(roots.select(F.col("id").alias("b"), F.col("root").alias("q")), "b").where("p != q")
    steps = written(ends.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("s")).select("s.*").distinct(), "steps")
    least = roots.select("root").distinct().select(F.col("root").alias("id"), "root")
    while True:
        seen = steps.join(least.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("seen"))
        stepped = least.join(seen.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("root", F.coalesce("seen", "root")).alias("root"))
        jumped = stepped.join(stepped.select(F.col("id").alias("root"), F.col("root").alias("far")), "root").select("id", F.least("root", "far").alias("root"))
        jumped = written(jumped, "least")
        if jumped.join(least.withColumnRenamed("root", "old"), "id").where("root != old").isEmpty():
            break
        least = jumped
    return written(roots.join(least.select(F.col("id").alias("root"), F.col("root").alias("to")), "root").select("id", F.col("to").alias("root")), "labels")


def least_size(n: int, k: int) -> int:
    return max(3, round(n / k * 0.25))


def choose(candidates: Sequence[tuple[str, int, float, Sequence[int]]]) -> tuple[str, int, float, Sequence[int]]:
    """The best (method, k, silhouette, sizes): clusters large enough first, then silhouette, then the order given."""
    sound = [c for c in candidates if min(c[3]) >= least_size(sum(c[3]), c[1])] or list(candidates)
    best = sound[0]
    for c in sound[1:]:
        if c[2] > best[2]:
            best = c
    return best


def pca(points: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """id, scores of centred points, and the explained variance. Signs are made so that the largest loading is positive."""
    size = len(points.first()["x"])
    means = points.agg(*(F.avg(F.get("x", F.lit(i))).alias(str(i)) for i in range(size))).first()
    centred = points.select("id", array_to_vector(F.array(*(F.get("x", F.lit(i)) - means[i] for i in range(size)))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(centred)
    parts = model.pc.toArray()
    signs = [1.0 if parts[np.argmax(np.abs(parts[:, j])), j] > 0 else -1.0 for j in range(k)]
    out = F.transform(F.arrays_zip(vector_to_array("scores").alias("s"), F.array(*map(F.lit, signs)).alias("g")), lambda z: z["s"] * z["g"])
    return model.transform(centred).select("id", out.alias("scores")), list(model.explainedVariance.toArray())
