"""Vectorised helpers: Gram sums of null models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_shift_gram(rows: DataFrame, columns: list[str], group: str, order: str, iterations: int, seed: int = 0) -> DataFrame:
    """iteration, gram (flat p * p sums of ZᵀZ) of standardised columns, each shifted circularly inside each group.

    Iteration 0 is unshifted. A shift only permutes a column inside a group, so means and deviations stay.
    """

    def shifted(table: pa.Table) -> pa.Table:
        z = np.column_stack([table[c].to_numpy() for c in columns])[np.argsort(table[order].to_numpy(), kind="stable")]
        name, n = table[group][0].as_py(), len(z)
        moved = lambda i: np.column_stack([np.roll(z[:, j], shift_of(seed, i, name, c, n) if i else 0) for j, c in enumerate(columns)])
        return _grams([(i, moved(i)) for i in range(iterations + 1)])

    return summed_grams(rows.select(group, order, *columns).groupBy(group).applyInArrow(shifted, GRAM))


def shift_of(seed: int, iteration: int, name: object, column: str, n: int) -> int:
    """A shift from 1 to n - 1 that depends on its arguments alone; 0 where there is none."""
    import xxhash

    return 1 + xxhash.xxh64_intdigest(f"{iteration}|{name}|{column}", seed) % (n - 1) if n > 1 else 0


def summed_grams(parts: DataFrame) -> DataFrame:
    """iteration, gram: the sums of flat partial Grams (iteration, gram)."""
    flat = parts.select("iteration", F.posexplode("gram").alias("i", "v")).groupBy("iteration", "i").agg(F.sum("v").alias("v"))
    return flat.groupBy("iteration").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("gram"))


GRAM = "iteration int, gram array<double>"


def _grams(found: list[tuple[int, np.ndarray]]) -> pa.Table:
    return pa.table({"iteration": pa.array([i for i, _ in found], pa.int32()), "gram": pa.array([(w.T @ w).ravel().tolist() for _, w in found], pa.list_(pa.float64()))})


def shuffled_gram(rows: DataFrame, columns: list[str], group: str, order: str, iterations: int, seed: int = 0, bucket: int = 4096) -> DataFrame:
    """iteration, gram of columns that are each permuted on their own; iteration 0 is not.

    Rows are dealt by hash into buckets of about `bucket` rows and permuted inside them, so no task holds a whole column.
    """
    n = max(1, -(-rows.count() // bucket))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), group, order), F.lit(n)).alias("_b"), group, order, *columns)

    def permuted(table: pa.Table) -> pa.Table:
        table = table.sort_by([(group, "ascending"), (order, "ascending")])
        z, b = np.column_stack([table[c].to_numpy() for c in columns]), table["_b"][0].as_py()
        mixed = lambda i, j: np.random.default_rng((seed, i, b, j)).permutation(z[:, j]) if i else z[:, j]
        return _grams([(i, np.column_stack([mixed(i, j) for j in range(len(columns))])) for i in range(iterations + 1)])

    return summed_grams(dealt.groupBy("_b").applyInArrow(permuted, GRAM))


def global_shift_gram(rows: DataFrame, columns: list[str], group: str, order: str, iterations: int, seed: int = 0, chunk: int = 4096) -> DataFrame:
    """iteration, gram of columns that are each shifted circularly over all rows, by group and order; iteration 0 is unshifted.

    Rows are numbered by their place in a group and the group's offset (a row a group) and packed into chunks. A chunk sends
    the stretches of its shifted columns to the chunks that they land in, which sum up their own part.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(group, (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_o"))
    n = rows.count()
    numbered = rows.select(group, *columns, place.alias("_p")).join(offsets, group).withColumn("_i", F.col("_o") + F.col("_p"))
    shifts = {(i, j): shift_of(seed, i, "", c, n) if i else 0 for i in range(iterations + 1) for j, c in enumerate(columns)}
    schema = pa.schema([("iteration", pa.int32()), ("target", pa.int64()), ("column", pa.int32()), ("start", pa.int64()), ("piece", pa.list_(pa.float64()))])

    def sent(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        first, z, out = table["_i"][0].as_py(), np.column_stack([table[c].to_numpy() for c in columns]), []
        for (i, j), s in shifts.items():
            at = 0
            while at < len(z):
                to = (first + at + s) % n
                m = min(len(z) - at, chunk - to % chunk, n - to)
                out.append((i, to // chunk, j, to % chunk, z[at : at + m, j].tolist()))
                at += m
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def landed(table: pa.Table) -> pa.Table:
        size = min(chunk, n - table["target"][0].as_py() * chunk)
        w = np.zeros((size, len(columns)))
        for j, a, piece in zip(table["column"].to_pylist(), table["start"].to_pylist(), table["piece"].to_pylist()):
            w[a : a + len(piece), j] = piece
        return _grams([(table["iteration"][0].as_py(), w)])

    pieces = numbered.groupBy(F.floor(F.col("_i") / chunk).alias("_c")).applyInArrow(sent, "iteration int, target long, column int, start long, piece array<double>")
    return summed_grams(pieces.groupBy("iteration", "target").applyInArrow(landed, GRAM))
