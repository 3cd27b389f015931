"""Neighbours in many dimensions by a partition into balls: all pairs within a radius, and the distance to the k-th nearest point.

About the square root of n points, chosen by hash, are centres; every point is at home in the cell of the nearest one, and a cell is a ball of known
radius around its centre. A point also visits another cell if that may hold a point near enough: by the triangle inequality it can't
be nearer to one than its distance to the centre less the radius, and not nearer than to the plane half-way between both
centres. So only border points are replicated. Inside a cell, points are sorted by their distance to the centre, and only those whose
distances differ by at most the radius asked for are compared. Cells of many points are dealt in blocks, so no task holds a
whole cell. Centres are a bounded number (`most`), as are the radii, which are all that reaches the driver.

Points without structure visit nearly all cells, so a copy for each visit would be about n sqrt(n) rows. Visits are therefore counted
first. Where they are more than the copies that a plain grid of blocks needs (two for each `BLOCK` points of the table), points meet
in that grid: still all pairs, but each point is written only once for each block of the other side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.sources.scratch import written

#: Rows of the left and of the right side of a cell that meet in one group.
LEFT, RIGHT = 2048, 8192
#: Rows of a side in a group of the plain grid, and rows and columns of it that are compared at once.
BLOCK, TILE = 65536, (256, 1024)
HOMES = "id long, x array<double>, cell int, far double"


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.unique(np.diff(column.offsets.to_numpy())) if len(column) else []
    if len(wide) != 1 or not wide[0] or column.null_count:
        return np.array(column.to_pylist(), float)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def rounding(*sides: np.ndarray) -> float:
    """More than the product form of a distance can be off, for rows of these sizes."""
    return 1e-6 + 1e-7 * max(float(np.sqrt((s * s).sum(1)).max(initial=0)) for s in sides)


def centres_of(points: DataFrame, most: int = 4096) -> np.ndarray:
    """About sqrt(n) different points by hash, `most` at most."""
    k = min(most, max(1, round(math.sqrt(points.count()))))
    chosen = points.select("x").distinct().orderBy(F.xxhash64("x")).limit(k)
    return matrix(chosen.toArrow()["x"])


def settled(points: DataFrame, centres: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Points with their cell and distance to its centre, as a written table; and the radius of each cell."""

    def run(batches):
        for batch in batches:
            d = distances(matrix(batch.column(1)), centres) if batch.num_rows else np.zeros((0, len(centres)))
            cell = d.argmin(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["id", "x", "cell", "far"])

    homes = written(points.select("id", "x").mapInArrow(run, HOMES), "homes")
    radius = np.full(len(centres), -np.inf)
    for r in homes.groupBy("cell").agg(F.max("far").alias("r")).collect():  # a row a centre
        radius[r["cell"]] = r["r"]
    return homes, radius


def going(batch: pa.RecordBatch, centres: np.ndarray, radius: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (id, x, cell, far, reach) of the batch go to which cells, and their distances to the centres."""
    x, cell, near = matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(4).to_numpy()
    d = distances(x, centres)
    homes_here, at = np.unique(cell, return_inverse=True)
    apart = distances(centres[homes_here], centres)[at]
    mine = d[np.arange(len(x)), cell][:, None]
    plane = np.where(apart > 0, (d * d - mine * mine) / (2 * np.maximum(apart, 1e-300)), 0)
    least = np.maximum(np.maximum(d - radius, plane), 0)
    goes = least <= (near * (1 + 1e-6) + 4 * rounding(x, centres))[:, None]
    goes[np.arange(len(x)), cell] = own
    return goes, d


def visits(homes: DataFrame, centres: np.ndarray, radius: np.ndarray, reach: str, own: bool) -> DataFrame:
    """id, x, reach, cell, far: each point with the cells that may hold a point within its column `reach` (of other cells than its own, without own)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            goes, d = going(batch, centres, radius, own)
            rows, cells = np.nonzero(goes)
            for start in range(0, len(rows), 10_000):
                r, c = rows[start : start + 10_000], cells[start : start + 10_000]
                taken = batch.select(["id", "x", reach]).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(c.astype(np.int32)), pa.array(d[r, c])], ["id", "x", "reach", "cell", "far"])

    return homes.select("id", "x", "cell", "far", reach).mapInArrow(run, "id long, x array<double>, reach double, cell int, far double")


def spared(homes: DataFrame, centres: np.ndarray, radius: np.ndarray, reach: str) -> bool:
    """Whether visits of cells are fewer than the copies of the plain grid."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(going(batch, centres, radius, False)[0].sum())]), pa.array([batch.num_rows])], ["visits", "n"])

    counts = homes.select("id", "x", "cell", "far", reach).mapInArrow(run, "visits long, n long").agg(F.sum("visits"), F.sum("n")).first()
    return counts[1] is None or counts[0] <= (2 * blocks(counts[1]) - 1) * counts[1]


def blocks(n: int) -> int:
    """Blocks of a side of n rows: of `BLOCK` rows at most, and a few where there are fewer."""
    return max(-(-n // BLOCK), min(8, -(-n // 2048)), 1)


def narrow(rows: DataFrame) -> DataFrame:
    """rows with x as floats of half the width, where that changes no value."""
    floats = F.transform("x", lambda v: v.cast("float"))
    lost = F.transform(floats, lambda v: v.cast("double")) != F.col("x")
    return rows.withColumn("x", floats) if rows.where(lost).isEmpty() else rows


def gridded(left: DataFrame, right: DataFrame):
    """Both sides (with id) in groups of bounded size, in which every row of the left side meets every row of the right one once."""
    p, q = blocks(left.count()), blocks(right.count())
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [F.col(c).alias(f"_{c}") for c in ("l", "r")]
    a, b = left.withColumn("l", part(p)).withColumn("r", every(q)), right.withColumn("r", part(q)).withColumn("l", every(p))
    return a.groupBy(*keys), b.groupBy(*keys)


def dealt(left: DataFrame, right: DataFrame):
    """Both sides (with cell) in groups of bounded size, in which every row of a cell's left side meets every row of its right side once."""
    counts = left.groupBy("cell").agg(F.count(F.lit(1)).alias("nl")).join(right.groupBy("cell").agg(F.count(F.lit(1)).alias("nr")), "cell")
    parts = written(counts.select("cell", F.ceil(F.col("nl") / LEFT).cast("int").alias("pl"), F.ceil(F.col("nr") / RIGHT).cast("int").alias("pr")), "cells")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(parts, "cell").withColumns({"l": part("pl"), "r": every("pr")}).drop("pl", "pr")
    b = right.join(parts, "cell").withColumns({"l": every("pl"), "r": part("pr")}).drop("pl", "pr")
    keys = [F.col(c).alias(f"_{c}") for c in ("cell", "l", "r")]
    return a.groupBy(*keys), b.groupBy(*keys)


def eps_cells(points: DataFrame, eps: float, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Points at home in their cells, and points with each cell that may hold a neighbour, their own among them."""
    centres = centres_of(points, most)
    homes, radius = settled(points, centres)
    return homes, visits(homes.withColumn("eps", F.lit(float(eps))), centres, radius, "eps", own=True)


class Layout(NamedTuple):
    """Points (id, x, cell, far) at home in cells, and whether cells spare comparisons within the radius eps."""

    homes: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    eps: float
    spares: bool


def layout(points: DataFrame, eps: float, most: int = 4096) -> Layout:
    centres = centres_of(points, most)
    homes, radius = settled(points, centres)
    return Layout(homes, centres, radius, eps, spared(homes.withColumn("eps", F.lit(float(eps))), centres, radius, "eps"))


def met(at: Layout, asking: DataFrame | None = None, asked: DataFrame | None = None):
    """Points that ask and points that are asked (ids with more columns; else all) in groups, in which all that lie within eps meet.

    The rows have `far`, their distance to a common point, where cells spare comparisons, else not.
    """
    joined = lambda rows, more: rows if more is None else rows.join(more, "id")
    again = lambda rows: rows.select(*(F.col(c).alias(c) for c in rows.columns))
    if not at.spares:
        homes = narrow(at.homes.select("id", "x"))
        return gridded(joined(homes, asking), again(joined(homes, asked)))
    right = at.homes if asked is None else at.homes.join(asked.select("id"), "id", "left_semi")
    visiting = visits(right.withColumn("eps", F.lit(float(at.eps))), at.centres, at.radius, "eps", own=True).drop("reach")
    return dealt(joined(at.homes, asking), again(joined(visiting, asked)))


def close(left: pa.Table, right: pa.Table, radii: Sequence[float], other: str = "id"):
    """(places on the left, places on the right, masks) of blocks of pairs; masks: those within each radius that differ in the column `other`."""
    if not left.num_rows or not right.num_rows:
        return
    a, b, of_a, of_b = matrix(left["x"]), matrix(right["x"]), left[other].to_numpy(), right[other].to_numpy()
    far = (left["far"].to_numpy(), right["far"].to_numpy()) if "far" in left.column_names else (None, None)
    shared = len(np.intersect1d(of_a, of_b)) > 0
    for rows, columns, masks in near_masks(a, b, radii, *far):
        if shared:
            differ = of_a[rows][:, None] != of_b[columns]
            masks = [mask & differ for mask in masks]
        yield rows, columns, masks


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product is the negative squared distances, and more than it can be off."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 1e-14 * (a.shape[1] + 8) * (aa.max(initial=0) + bb.max(initial=0))
    return np.column_stack((2 * a, np.ones(len(a)), aa)), np.column_stack((b, -bb, -np.ones(len(b)))), slack


def squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs by subtraction."""
    parts = [((a[i[at : at + 65536]] - b[j[at : at + 65536]]) ** 2).sum(axis=1) for at in range(0, len(i), 65536)]
    return np.concatenate([np.zeros(0), *parts])


def near_masks(a: np.ndarray, b: np.ndarray, radii: Sequence[float], far_a: np.ndarray | None = None, far_b: np.ndarray | None = None):
    """(places in a, places in b, masks of the pairs within each radius) of blocks; far: distances to one common point, which spare pairs."""
    one, two, slack = products(a, b)
    band = max(radii) + 2 * rounding(a, b)

    def tile(rows, columns, other):
        sums, masks = one[rows] @ other.T, []
        for eps in radii:
            mask = sums >= slack - eps * eps
            i, j = np.nonzero((sums >= -slack - eps * eps) ^ mask)  # too near to the limit to be sure of
            if len(i):
                mask[i, j] = np.sqrt(squares(a, b, rows[i], columns[j])) <= eps
            masks.append(mask)
        return rows, columns, masks

    if far_a is None:
        for at in range(0, len(b), TILE[1]):
            columns = np.arange(at, min(at + TILE[1], len(b)))
            for start in range(0, len(a), TILE[0]):
                yield tile(np.arange(start, min(start + TILE[0], len(a))), columns, two[at : at + TILE[1]])
        return
    order_a, order_b = np.argsort(far_a, kind="stable"), np.argsort(far_b, kind="stable")
    sorted_b = far_b[order_b]
    for start in range(0, len(a), 32):
        rows = order_a[start : start + 32]
        lo, hi = np.searchsorted(sorted_b, far_a[rows[0]] - band), np.searchsorted(sorted_b, far_a[rows[-1]] + band, "right")
        yield tile(rows, order_b[lo:hi], two[order_b[lo:hi]])


def close_pairs(a: np.ndarray, b: np.ndarray, far_a: np.ndarray, far_b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in a and b of the pairs within eps, and how many pairs were compared; far: distances to one common point."""
    left, right, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for rows, columns, (mask,) in near_masks(a, b, [eps], far_a, far_b):
        i, j = np.nonzero(mask)
        left.append(rows[i])
        right.append(columns[j])
        seen += mask.size
    return np.concatenate(left), np.concatenate(right), seen


def eps_neighbours(points: DataFrame, eps: float, most: int = 4096) -> DataFrame:
    """a, b of points (id, x) within eps of each other, in both directions. Where only numbers are asked for, `eps_degrees` spares the pairs."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "a long, b long")

    def meet(left, right):
        out = [np.zeros((2, 0), np.int64)]
        for rows, columns, (mask,) in close(left, right, [eps]):
            i, j = np.nonzero(mask)
            out.append(np.stack((left["id"].to_numpy()[rows[i]], right["id"].to_numpy()[columns[j]])))
        return pa.table(list(np.concatenate(out, axis=1)), names=["a", "b"])

    left, right = met(layout(points, eps, most))
    return left.cogroup(right).applyInArrow(meet, "a long, b long")


def eps_degrees(points: DataFrame, eps: float, at: Layout | None = None) -> DataFrame:
    """id, n: how many other points (id, x; with a weight w: of what weight) lie within eps of each point, where there are any; pairs are counted as they meet."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "id long, n long")
    return degrees(points, at or layout(points, eps), [eps]).select("id", F.get("n", F.lit(0)).alias("n"))


def degrees(points: DataFrame, at: Layout, radii: Sequence[float]) -> DataFrame:
    """id, n: the same for each of the radii, up to the one that points are laid out for; points without any neighbour are left out."""
    weighted = "w" in points.columns

    def meet(left, right):
        n = np.zeros((len(radii), left.num_rows), np.int64)
        w = right["w"].to_numpy() if weighted else np.ones(right.num_rows, np.int64)
        single = (w == 1).all()
        for rows, columns, masks in close(left, right, radii):
            for k, mask in enumerate(masks):
                n[k, rows] += np.count_nonzero(mask, axis=1) if single else np.rint(mask @ w[columns].astype(float)).astype(np.int64)
        some = n.any(axis=0)
        return pa.table([left["id"].to_numpy()[some], *n[:, some]], names=["id", *(f"n{k}" for k in range(len(radii)))])

    left, right = met(at, None, points.select("id", "w") if weighted else None)
    counts = left.cogroup(right).applyInArrow(meet, ", ".join(["id long", *(f"n{k} long" for k in range(len(radii)))]))
    return counts.groupBy("id").agg(F.array(*(F.sum(f"n{k}") for k in range(len(radii)))).alias("n"))


def least_neighbours(at: Layout, asking: DataFrame | None, asked: DataFrame, other: str = "id") -> DataFrame:
    """id, b: for each asking point and group the smallest asked id within eps that differs in the column `other`."""

    def meet(left, right):
        right = right.sort_by("id")
        ids, found = right["id"].to_numpy(), np.full(left.num_rows, -1)
        for rows, columns, (mask,) in close(left, right, [eps], other):
            if not mask.shape[1]:
                continue
            if "far" in left.column_names:  # there columns don't come by id
                order = np.argsort(columns)
                columns, mask = columns[order], mask[:, order]
            first = mask.argmax(axis=1)
            new = mask[np.arange(len(rows)), first] & (found[rows] < 0)
            found[rows[new]] = columns[first[new]]
        some = found >= 0
        return pa.table([left["id"].to_numpy()[some], ids[found[some]]], names=["id", "b"])

    eps = at.eps
    left, right = met(at, asking, asked)
    return left.cogroup(right).applyInArrow(meet, "id long, b long")


def _nearest(k: int):
    """id and its k least distances of each row of the left side to others of the right one."""

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        a, b, a_ids, b_ids = matrix(left["x"]), matrix(right["x"]), left["id"].to_numpy(), right["id"].to_numpy()
        ids, out, (one, two, slack) = [np.zeros(0, np.int64)], [np.zeros(0)], products(a, b)
        step, width = max(1, (1 << 22) // len(b)), max(1, len(b) // (16 * k + 64))
        for start in range(0, len(a), step):
            rows = slice(start, start + step)
            s = one[rows] @ two.T
            s[a_ids[rows][:, None] == b_ids] = -np.inf
            # The k-th of the best of each stretch of columns is no better than the k-th of all.
            best = np.maximum.reduceat(s, np.arange(0, len(b), width), axis=1)
            at = min(k, best.shape[1]) - 1
            kth = -np.partition(-best, at, axis=1)[:, at]
            # Those that rounding of the product form may have put behind the k-th are taken along, then distances are taken by subtraction.
            i, j = np.nonzero((s >= (kth - 2 * slack)[:, None]) & (s > -np.inf))
            exact = np.sqrt(squares(a, b, start + i, j))
            order = np.lexsort((exact, i))
            i, exact = i[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            ids.append(a_ids[rows][i[place < k]])
            out.append(exact[place < k])
        return pa.table({"id": np.concatenate(ids), "distance": np.concatenate(out)})

    return meet


def nearest(points: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """id, distance to the k-th nearest other point; null with fewer.

    A point's k-th distance in its own cell bounds the final one, so it visits only cells that may hold a nearer point.
    """
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], "id long, distance double")
    centres = centres_of(points, most)
    homes, radius = settled(points, centres)
    sides = homes.select("cell", "id", "x")
    left, right = dealt(sides, sides.select(*(F.col(c).alias(c) for c in sides.columns)))
    own = written(left.cogroup(right).applyInArrow(_nearest(k), "id long, distance double"), "own")
    bounded = homes.join(own.groupBy("id").agg(_kth(k).alias("reach")), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    bounded = written(bounded, "bounded")
    if spared(bounded, centres, radius, "reach"):
        left, right = dealt(visits(bounded, centres, radius, "reach", own=False).select("cell", "id", "x"), sides)
    else:
        whole = narrow(homes.select("id", "x"))
        left, right = gridded(whole, whole.select(*(F.col(c).alias(c) for c in whole.columns)))
        own = None  # all pairs meet there
    others = left.cogroup(right).applyInArrow(_nearest(k), "id long, distance double")
    best = (others if own is None else own.unionByName(others)).groupBy("id").agg(_kth(k).alias("distance"))
    return points.select("id").join(best, "id", "left")


def _kth(k: int) -> Column:
    return F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1))
