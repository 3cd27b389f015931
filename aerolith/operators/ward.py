"""Ward's clustering of any number of points: rounds of merges of clusters that are each other's nearest, with the linkage as a table.

The cost of a merge is n_a n_b / (n_a + n_b) times the squared distance of the means. Two clusters that are each other's cheapest partner
stay so whatever else is merged, so all such pairs are merged at once, and the linkage, sorted by cost, is that of merging one pair
after the other. Partners are looked for in the ball partition: the cheapest one in a cluster's own cell bounds the distance of any cheaper
one. Pairs are ordered by (cost, ids), so each round merges one pair at least, and usually a third of all clusters. The last `SMALL`
clusters, a bounded number, are merged in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.neighbours import centres_of, dealt, gridded, matrix, products, settled, spared, squares, visits
from aerolith.sources.scratch import written

SMALL = 2048
LINKAGE = "a long, b long, cost double, size long"
_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cost", pa.float64()), ("size", pa.int64())])
_PARTNER = pa.schema([("id", pa.int64()), ("partner", pa.int64()), ("cost", pa.float64())])


def cheapest(ids: np.ndarray, n: np.ndarray, x: np.ndarray, o_ids: np.ndarray, o_n: np.ndarray, o_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partner, cost) of each row among the others, ties by the pair's smaller, then larger id; -1 and infinity without any."""
    partner, least = np.full(len(ids), -1, np.int64), np.full(len(ids), np.inf)
    if not len(o_ids):
        return partner, least
    one, two, slack = products(x, o_x)
    step = max(1, min(256, (1 << 21) // len(o_ids)))
    for start in range(0, len(ids), step):
        rows = slice(start, start + step)
        rough = -(one[rows] @ two.T) / (1 / n[rows][:, None] + 1 / o_n)
        rough[ids[rows][:, None] == o_ids] = np.inf
        # A merge weighs less than the number of points of either side.
        i, j = np.nonzero((rough <= (rough.min(axis=1) * (1 + 1e-9) + 2 * n[rows] * slack)[:, None]) & np.isfinite(rough))
        weight = n[rows][i] * o_n[j] / (n[rows][i] + o_n[j])
        exact = weight * squares(x, o_x, start + i, j)
        a, b = np.minimum(ids[rows][i], o_ids[j]), np.maximum(ids[rows][i], o_ids[j])
        order = np.lexsort((b, a, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        partner[start + i[first]], least[start + i[first]] = o_ids[j[first]], exact[first]
    return partner, least


def _finished(table: pa.Table) -> pa.Table:
    """All merges of a bounded number of clusters (id, n, x)."""
    table = table.sort_by("id")
    ids, n, x = table["id"].to_numpy(), table["n"].to_numpy().astype(float), matrix(table["x"])
    out = []
    while len(ids) > 1:
        partner, cost = cheapest(ids, n, x, ids, n, x)
        at = np.searchsorted(ids, partner)
        pair = np.flatnonzero((partner[at] == ids) & (ids < partner))
        other = at[pair]
        total = n[pair] + n[other]
        out += zip(ids[pair].tolist(), ids[other].tolist(), cost[pair].tolist(), total.astype(int).tolist())
        x[pair] = (x[pair] * n[pair][:, None] + x[other] * n[other][:, None]) / total[:, None]
        n[pair] = total
        kept = np.setdiff1d(np.arange(len(ids)), other)
        ids, n, x = ids[kept], n[kept], x[kept]
    return pa.table([list(c) for c in zip(*out)] if out else [[]] * 4, schema=_SCHEMA)


def _partners(left: pa.Table, right: pa.Table) -> pa.Table:
    side = lambda t: (t["id"].to_numpy(), t["n"].to_numpy().astype(float), matrix(t["x"]))
    if not left.num_rows or not right.num_rows:
        return _PARTNER.empty_table()
    partner, cost = cheapest(*side(left), *side(right))
    return pa.table([left["id"].combine_chunks(), partner, cost], schema=_PARTNER).filter(pa.array(partner >= 0) if (partner < 0).any() else pa.array(np.ones(len(partner), bool)))


def least(rows: DataFrame) -> DataFrame:
    """id, cost, partner: the cheapest of each cluster's partners."""
    return rows.groupBy("id").agg(F.min(F.struct("cost", F.least("id", "partner").alias("lo"), F.greatest("id", "partner").alias("hi"), "partner")).alias("m")).select("id", "m.cost", "m.partner")


def partners(clusters: DataFrame) -> DataFrame | None:
    """id, cost, partner of the cheapest merge of each cluster (id, n, x), by cells; None where cells spare nothing."""
    centres = centres_of(clusters)
    homes, radius = settled(clusters, centres)
    homes = homes.join(clusters.select("id", "n"), "id")
    sides = homes.select("cell", "id", "n", "x")
    again = sides.select(*(F.col(c).alias(c) for c in sides.columns))
    left, right = dealt(sides, again)
    own = written(least(left.cogroup(right).applyInArrow(_partners, "id long, partner long, cost double")), "own")
    # A partner of one point at least costs n / (n + 1) of the squared distance or more.
    reach = F.coalesce(F.sqrt(F.col("cost") * (F.col("n") + 1) / F.col("n")), F.lit(float("inf")))
    asking = written(homes.join(own, "id", "left").withColumn("reach", reach).select("id", "x", "cell", "far", "reach"), "asking")
    if not spared(asking, centres, radius, "reach"):
        return None
    asking = visits(asking, centres, radius, "reach", own=False).select("id", "x", "cell").join(clusters.select("id", "n"), "id")
    left, right = dealt(asking.select("cell", "id", "n", "x"), again)
    others = left.cogroup(right).applyInArrow(_partners, "id long, partner long, cost double")
    return least(own.select("id", "partner", "cost").unionByName(others))


def partners_of(asking: DataFrame, clusters: DataFrame, known: DataFrame | None) -> DataFrame:
    """id, cost, partner of each cluster in a plain grid; with known partners, the other clusters only meet those that ask."""

    both = known is not None

    def meet(left, right):
        there = _partners(left, right)
        return pa.concat_tables([there, _partners(right, left)]) if both else there

    left, right = gridded(asking, clusters.select(*(F.col(c).alias(c) for c in clusters.columns)))
    found = left.cogroup(right).applyInArrow(meet, "id long, partner long, cost double")
    return least(found.unionByName(known.select("id", "partner", "cost")) if both else found)


def linkage(points: DataFrame) -> DataFrame:
    """a, b, cost, size of every merge of points (id, x): cluster b goes into a; a cluster has its smallest member's id as its name."""
    clusters = written(points.select(F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), "x"), "clusters")
    done = known = None
    spares = True
    while clusters.count() > SMALL:
        found = partners(clusters) if spares else None
        if found is None:  # from here on in a grid, where a cluster asks again only when its partner has been merged
            spares = False
            asking = clusters if known is None else clusters.join(known.select("id"), "id", "left_anti")
            found = partners_of(asking, clusters, known)
        found = written(found, "partners")
        back = found.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        pairs = found.where("id < partner").join(back, ["id", "partner"]).select(F.col("id").alias("a"), F.col("partner").alias("b"), "cost")
        one, two = (clusters.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}")) for k in ("a", "b"))
        size = F.col("na") + F.col("nb")
        mean = F.zip_with("xa", "xb", lambda p, q: (p * F.col("na") + q * F.col("nb")) / (F.col("na") + F.col("nb")))
        merged = written(pairs.join(one, "a").join(two, "b").select("a", "b", "cost", size.alias("size"), mean.alias("x")), "merged")
        gone = merged.select(F.explode(F.array("a", "b")).alias("id"))
        if not spares:
            known = found.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "partner"), "partner", "left_anti").select("id", "partner", "cost")
        clusters = written(clusters.join(gone, "id", "left_anti").unionByName(merged.select(F.col("a").alias("id"), F.col("size").alias("n"), "x")), "clusters")
        part = merged.select("a", "b", "cost", "size")
        done = part if done is None else done.unionByName(part)
    last = clusters.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_finished, LINKAGE)
    return written(last if done is None else done.unionByName(last), "linkage")


def cuts(points: DataFrame, ks: Sequence[int]) -> dict[int, DataFrame]:
    """points with cluster (the smallest id in it) for each number of clusters; with fewer points, each is one."""
    merges, most = linkage(points), max(ks)
    top = merges.orderBy(F.desc("cost"), F.desc("size"), F.desc("a"), F.desc("b")).limit(most - 1).collect()  # a row a cluster
    spark = points.sparkSession
    names = points.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("root"))
    held = spark.createDataFrame([(r["b"],) for r in top], "b long")
    steps = written(merges.join(held, "b", "left_anti").select(F.col("b").alias("root"), F.col("a").alias("into")), "steps")
    while True:  # pointer jumping, until all lead to clusters that were merged no further
        further = steps.select(F.col("root").alias("into"), F.col("into").alias("far"))
        jumped = written(steps.join(further, "into", "left").select("root", F.coalesce("far", "into").alias("into"), F.col("far").isNotNull().alias("moved")), "steps")
        steps = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    names = written(names.join(steps, "root", "left").select("id", F.coalesce("into", "root").alias("root")), "names")
    out = {}
    for k in ks:
        into: dict[int, int] = {}
        for r in top[k - 1 :]:
            into[r["b"]] = r["a"]
        ends = {b: b for b in into}
        for b in into:
            while ends[b] in into:
                ends[b] = into[ends[b]]
        label = F.create_map(*(F.lit(x).cast("long") for pair in ends.items() for x in pair)) if ends else None
        root = F.col("root") if label is None else F.coalesce(F.try_element_at(label, F.col("root")), F.col("root"))
        out[k] = points.select("id", "x").join(names.select("id", root.alias("cluster")), "id")
    return out
