"""Silhouettes: exact ones that meet only the clusters that can be a point's nearest, and the squared form from sums alone.

The mean distance of a point to the members of a cluster is at least d, its distance to the centre, and at most sqrt(d² + v), v being
the members' mean squared distance to the centre. A cluster whose lower bound is above another's upper bound can't be the
nearest one, so its members are not met. Of equal points in a cluster one is kept with their number. The mean squared distance is
d² + v itself, so the squared form needs no pairs at all.

Only a block of about `MOST` centres reaches the driver at a time. Points and members meet in groups of bounded size.

Where the bounds spare little, a copy of a point for each cluster that it may be nearest to is more than a grid of blocks needs. The
copies are counted first; then each point goes once to each block of members, which holds a part of one large cluster or whole small ones,
of which it gives the nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators import neighbours
from aerolith.operators.neighbours import dealt, distances, matrix, narrow, products, rounding, squares
from aerolith.sources.scratch import written

#: Centres that a pass compares every point with.
MOST = 4096
BOUNDS = "id long, x array<double>, w long, cluster long, other long, size long, upper double"


def kinds_of(labelled: DataFrame) -> DataFrame:
    """id (the smallest), x, cluster, w: each distinct point of a cluster and how often it occurs; noise and nulls are left out."""
    return written(labelled.where("cluster >= 0 and x is not null").groupBy("x", F.col("cluster").cast("long").alias("cluster")).agg(F.min(F.col("id").cast("long")).alias("id"), F.count(F.lit(1)).alias("w")), "kinds")


def moments(labelled: DataFrame) -> DataFrame:
    """cluster, centre, v, n."""
    long = labelled.where("cluster >= 0").select(F.col("cluster").cast("long").alias("cluster"), F.posexplode("x").alias("i", "v"))
    by_part = long.groupBy("cluster", "i").agg(F.avg("v").alias("centre"), F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return by_part.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "centre")))["centre"].alias("centre"), F.sum("v").alias("v"), F.max("n").alias("n"))


def passes(centres: DataFrame):
    """Names, centres, v and n of the clusters, a block at a time."""
    blocks = max(1, -(-centres.count() // MOST))
    for b in range(blocks):
        rows = centres.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b).collect()  # about MOST rows
        if rows:
            yield np.array([r["cluster"] for r in rows], np.int64), np.array([r["centre"] for r in rows], float), np.array([r["v"] for r in rows], float), np.array([r["n"] for r in rows], np.int64)


def reached(batch: pa.RecordBatch, names: np.ndarray, middle: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which clusters each row of the batch has to meet, and the upper and lower bounds of its mean distances."""
    x, own = matrix(batch.column("x")), batch.column("cluster").to_numpy()[:, None] == names
    shift = middle.mean(axis=0)
    d, slack = distances(x - shift, middle - shift), rounding(x - shift, middle - shift)
    upper = np.where(own, np.inf, np.sqrt((d + slack) ** 2 + v))
    return own | (d - slack <= upper.min(axis=1)[:, None]), upper, d - slack


def spared(kinds: DataFrame, centres: DataFrame) -> bool:
    """Whether the copies of meeting candidates alone are fewer than those of the grid."""
    out = None
    for names, middle, v, _ in passes(centres):

        def run(batches, names=names, middle=middle, v=v):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(reached(batch, names, middle, v)[0].sum(axis=0))], ["cluster", "nl"])

        one = kinds.select("x", "cluster").mapInArrow(run, "cluster long, nl long")
        out = one if out is None else out.unionByName(one)
    counts = out.groupBy("cluster").agg(F.sum("nl").alias("nl")).join(kinds.groupBy("cluster").agg(F.count(F.lit(1)).alias("nr")), "cluster")
    left, right = F.col("nl") * F.ceil(F.col("nr") / neighbours.RIGHT), F.col("nr") * F.ceil(F.col("nl") / neighbours.LEFT)
    copies, n = counts.agg(F.sum(left + right), F.sum("nr")).first()
    return copies <= 2 * neighbours.blocks(n) * n


def candidates(kinds: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with their own cluster and each other one that may be their nearest (other, its size, and the upper bound)."""
    out, blocks = None, 0
    for names, middle, v, n in passes(centres):

        def run(batches, names=names, middle=middle, v=v, n=n):
            for batch in batches:
                if not batch.num_rows:
                    continue
                going, upper, lower = reached(batch, names, middle, v)
                i, j = np.nonzero(going)
                for start in range(0, len(i), 10_000):
                    r, c = i[start : start + 10_000], j[start : start + 10_000]
                    taken = batch.select(["id", "x", "w", "cluster"]).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[c]), pa.array(n[c]), pa.array(upper[r, c]), pa.array(lower[r, c])], ["id", "x", "w", "cluster", "other", "size", "upper", "lower"])

        one = kinds.select("id", "x", "w", "cluster").mapInArrow(run, BOUNDS + ", lower double")
        out, blocks = one if out is None else out.unionByName(one), blocks + 1
    if blocks > 1:
        least = F.min("upper").over(Window.partitionBy("id"))
        out = out.withColumn("least", least).where("other = cluster or lower <= least").drop("least")
    return written(out.drop("lower", "upper"), "candidates")


def _totals(left, right):
    """Sums of weighted distances of the left rows to all right ones; both sides are moved to the middle of the right one first."""
    schema = pa.schema([("id", pa.int64()), ("w", pa.int64()), ("own", pa.bool_()), ("size", pa.int64()), ("other", pa.int64()), ("total", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    a, b, w = matrix(left["x"]), matrix(right["x"]), right["w"].to_numpy().astype(float)
    a_ids, b_ids, shift = left["id"].to_numpy(), right["id"].to_numpy(), b.mean(axis=0)
    a, b, total = a - shift, b - shift, np.zeros(len(a))
    for start in range(0, len(a), 256):
        rows = slice(start, start + 256)
        d = distances(a[rows], b)
        d[a_ids[rows][:, None] == b_ids] = 0
        total[rows] = d @ w
    return pa.table([left["id"], left["w"], left["own"], left["size"], left["cell"], pa.array(total)], schema=schema)


def _nearest_totals(left, right):
    """The same of the left rows to the members of their own cluster, and to those of the nearest other whole cluster or of a part of one cluster."""
    names = ["id", "own", "size", "other", "total"]
    if not left.num_rows or not right.num_rows:
        return pa.table([[], [], [], [], []], schema=pa.schema([("id", pa.int64()), ("own", pa.bool_()), ("size", pa.int64()), ("other", pa.int64()), ("total", pa.float64())]))
    right = right.sort_by("cluster")
    a, b, w = matrix(left["x"]), matrix(right["x"]), right["w"].to_numpy().astype(float)
    a_ids, b_ids, mine, of, shift = left["id"].to_numpy(), right["id"].to_numpy(), left["cluster"].to_numpy(), right["cluster"].to_numpy(), b.mean(axis=0)
    one, two, slack = products(a - shift, b - shift)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    clusters, size, shared = of[starts], right["size"].to_numpy()[starts], len(np.intersect1d(a_ids, b_ids)) > 0
    place, out = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(of)))), []
    for start in range(0, len(a), 128):
        rows = slice(start, start + 128)
        total = np.zeros((len(a_ids[rows]), len(starts)))
        for at in range(0, len(b), 1024):
            columns = slice(at, at + 1024)
            d = -(one[rows] @ two[columns].T)
            i, j = np.nonzero(d <= 1e5 * slack)  # too near for the product form
            d[i, j] = squares(a, b, start + i, at + j)
            d = np.sqrt(d)
            if shared:
                d[a_ids[rows][:, None] == b_ids[columns]] = 0
            d *= w[columns]
            here = place[columns]
            edges = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            total[:, here[edges]] += np.add.reduceat(d, edges, axis=1)
        own = mine[rows][:, None] == clusters
        i, j = np.nonzero(own)
        out.append((a_ids[rows][i], np.ones(len(i), bool), size[j], clusters[j], total[i, j]))
        mean = np.where(own, np.inf, total / size)
        j = mean.argmin(axis=1)
        i = np.flatnonzero(np.isfinite(mean[np.arange(len(j)), j]))
        out.append((a_ids[rows][i], np.zeros(len(i), bool), size[j[i]], clusters[j[i]], total[i, j[i]]))
    return pa.table([np.concatenate(c) for c in zip(*out)], names=names)


def in_grid(kinds: DataFrame):
    """Points and members in groups: every point meets every block of members once. A cluster of over half a block has blocks of its own, others are dealt whole."""
    sizes = written(kinds.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("size")), "sizes")
    n = kinds.count()
    p = neighbours.blocks(n)
    most = -(-n // p)
    large, q = [], 0
    for r in sizes.where(F.col("m") * 2 > most).collect():  # two a block at most
        large.append((r["cluster"], q, -(-r["m"] // most)))
        q += large[-1][2]
    rest = -(-(n - (sizes.where(F.col("m") * 2 > most).agg(F.sum("m")).first()[0] or 0)) // most)
    own = kinds.sparkSession.createDataFrame(large, "cluster long, first int, parts int")
    at = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(q + F.pmod(F.xxhash64("cluster"), F.lit(max(rest, 1)))).cast("int")
    rows = narrow(kinds.select("id", "x", "w", "cluster"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select("id", "x", "cluster", F.pmod(F.xxhash64("id"), F.lit(p)).cast("int").alias("l")).withColumn("r", every(q + rest))
    right = rows.join(sizes.select("cluster", "size"), "cluster").join(F.broadcast(own), "cluster", "left").withColumn("r", at).drop("first", "parts").withColumn("l", every(p))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    keys = [F.col(c).alias(f"_{c}") for c in ("l", "r")]
    return left.groupBy(*keys), right.groupBy(*keys)


def of_kinds(labelled: DataFrame, squared: bool = False) -> DataFrame:
    """x, cluster, w, silhouette of each distinct point of a cluster; 0 where the cluster has one point, null where it is the only cluster."""
    kinds, centres = kinds_of(labelled), written(moments(labelled), "centres")
    if squared:
        means = _squared(kinds, centres)
    else:
        means = _means(kinds, centres)
    more = F.greatest("a", "b")
    value = F.when(F.col("b").isNull(), None).when(F.col("a").isNull() | (more == 0), 0.0).otherwise((F.col("b") - F.col("a")) / more)
    return kinds.join(means, "id").select("x", "cluster", "w", value.alias("silhouette"))


def _means(kinds: DataFrame, centres: DataFrame) -> DataFrame:
    """id, a, b: mean distances to the own and to the nearest other cluster."""
    if spared(kinds, centres):
        found = candidates(kinds, centres)
        sides = found.select(F.col("other").alias("cell"), "id", "x", "w", (F.col("other") == F.col("cluster")).alias("own"), "size"), kinds.select(F.col("cluster").alias("cell"), "id", "x", "w")
        left, right = dealt(*sides)
        totals = left.cogroup(right).applyInArrow(_totals, "id long, w long, own boolean, size long, other long, total double")
    else:
        left, right = in_grid(kinds)
        totals = left.cogroup(right).applyInArrow(_nearest_totals, "id long, own boolean, size long, other long, total double")
    sums = totals.groupBy("id", "own", "size", "other").agg(F.sum("total").alias("total"))
    own = F.max(F.when(F.col("own"), F.try_divide(F.col("total"), F.col("size") - 1)))
    return sums.groupBy("id").agg(own.alias("a"), F.min(F.when(~F.col("own"), F.col("total") / F.col("size"))).alias("b"))


def _squared(kinds: DataFrame, centres: DataFrame) -> DataFrame:
    """id, a, b: mean squared distances to the own and to the nearest other cluster."""
    out = None
    for names, middle, v, n in passes(centres):

        def run(batches, names=names, middle=middle, v=v, n=n):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own = matrix(batch.column("x")), batch.column("cluster").to_numpy()[:, None] == names
                shift = middle.mean(axis=0)
                mean = distances(x - shift, middle - shift) ** 2 + v
                at, here = own.argmax(axis=1), own.any(axis=1) & (n[own.argmax(axis=1)] > 1)
                a = mean[np.arange(len(x)), at] * n[at] / np.maximum(n[at] - 1, 1)
                b = np.where(own, np.inf, mean).min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a, mask=~here), pa.array(b, mask=~np.isfinite(b))], ["id", "a", "b"])

        one = kinds.select("id", "x", "cluster").mapInArrow(run, "id long, a double, b double")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b"))


def silhouettes(labelled: DataFrame, squared: bool = False) -> DataFrame:
    """id, cluster, silhouette of points (id, x, cluster) but noise (a negative cluster)."""
    if labelled.where("cluster >= 0").isEmpty():
        return labelled.sparkSession.createDataFrame([], "id long, cluster long, silhouette double")
    points = labelled.select(F.col("id").cast("long").alias("id"), "x", F.col("cluster").cast("long").alias("cluster"))
    return points.join(of_kinds(labelled, squared), ["x", "cluster"]).select("id", "cluster", "silhouette")


def mean_silhouette(labelled: DataFrame, squared: bool = False) -> float:
    """The mean over all points but noise; -2 with fewer than two clusters."""
    if labelled.where("cluster >= 0").select("cluster").distinct().limit(2).count() < 2:
        return -2.0
    w = F.col("w").cast("double")
    return of_kinds(labelled, squared).agg(F.sum(w * F.col("silhouette")) / F.sum(w)).first()[0]
