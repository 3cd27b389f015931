"""Operator 6: exact top-k inner products with a pivot table.

Vectors get one more coordinate that brings all to one length, so that a larger inner product is a smaller distance. A
pivot table holds each vector's distances to the pivots (as many as the parameter says, chosen by hash). For a query,
the largest difference of its and a candidate's distances to a pivot is a lower bound of their distance, which gives an
upper bound of their score.

Candidates lie in blocks: those nearest to one pivot, in rings of their distance to it, so a block's smallest and largest
distance to each pivot bound all its members at once. A query first meets the blocks of highest bound; its k-th best score there
is its threshold, below the final one. Then it goes to just those other blocks whose bound reaches the threshold, and candidates
inside are evaluated in the order of their own bounds until the k-th best score is above the bound of all that are left.
Queries meet block bounds in pages of bounded size, and blocks in groups of bounded size; no task sees all of either.

Components are floor(scale * x); scores are integers and exact. Defined results: vectors that are null or hold null or
non-finite components, and rows without an id, take no part; shorter vectors count as padded with zeros; rows that
repeat id and vector count once; a query is never its own partner, by id; ties go to the smaller id; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.shared import ceil_div, written

#: Scores under this are exact in 32-bit floats, under the next in 64-bit floats.
EXACT_32, EXACT_64 = 1 << 24, 1 << 53
#: Candidates evaluated at first; each further step takes twice as many.
STEP = 128


def components(vector: str, scale: int) -> F.Column:
    """Integer components, null where the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        values = v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else np.asarray(v)
        out[i, : len(values)] = values
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows of a with the rows of b."""
    most = np.sqrt(float((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * float((b.astype(float) ** 2).sum(axis=1).max(initial=0)))
    if most >= EXACT_64 / 2:
        return a.astype(object) @ b.astype(object).T
    kind = np.float32 if most < EXACT_32 / 2 else np.float64
    return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def pivot_table(v: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Distances to the pivots; a query's extra coordinate is zero."""
    v, pivots = v.astype(float), pivots.astype(float)
    n, p = (v * v).sum(axis=1), (pivots * pivots).sum(axis=1)
    extra = 0 if query else np.sqrt(np.maximum(longest - n, 0))[:, None] * np.sqrt(np.maximum(longest - p, 0))
    squares = (n[:, None] if query else longest) + longest - 2 * (v @ pivots.T + extra)
    return np.sqrt(np.maximum(squares, 0))


def upper(query_norm: np.ndarray, gaps: np.ndarray, longest: float) -> np.ndarray:
    """Upper bound of scores from lower bounds of distances; rounding of the table never cuts a candidate off."""
    gaps = np.maximum(gaps - 1e-5 * (np.sqrt(longest) + 1), 0)
    return (query_norm + longest - gaps * gaps) / 2 * (1 + 1e-9) + 1e-3


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, q_table: np.ndarray, c_table: np.ndarray, longest: float, k: int, floors: np.ndarray) -> tuple[list[tuple], int]:
    """(query, candidate, score) of the k best candidates of each query that reach its floor, and how many were evaluated."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, c_table = c_ids[order], c[order], c_table[order].astype(np.float32)
    norms = np.sqrt((q.astype(float) ** 2).sum(axis=1).max(initial=0) * (c.astype(float) ** 2).sum(axis=1).max(initial=0))
    kind = np.float32 if norms < EXACT_32 / 2 else np.float64 if norms < EXACT_64 / 2 else object
    q, c = q.astype(kind), c.astype(kind)
    out, evaluated = [], 0
    for i, query in enumerate(q_ids):
        gaps = np.abs(c_table - q_table[i].astype(np.float32)).max(axis=1).astype(float)
        bound = upper(float((q[i].astype(float) ** 2).sum()), gaps, longest)
        left = np.flatnonzero(bound >= floors[i])
        ranked = left[np.argsort(-bound[left], kind="stable")]
        at, step, scores, ids = 0, STEP, np.zeros(0, kind), np.zeros(0, np.int64)
        while at < len(ranked) and (len(ids) < k or bound[ranked[at]] >= scores[k - 1]):
            take = ranked[at : at + step]
            evaluated += len(take)
            take = take[c_ids[take] != query]
            scores, ids = np.concatenate((scores, c[take] @ q[i])), np.concatenate((ids, c_ids[take]))
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
            at, step = at + step, 2 * step
        out += [(int(query), int(x), int(s)) for x, s in zip(ids, scores) if s >= floors[i]]
    return out, evaluated


def blocks_of(tabled: DataFrame, block: int, rings: int = 256) -> DataFrame:
    """tabled (with cell and own distance) with column block: about `block` vectors of neighbouring rings of one cell.

    Vectors are counted by cell and ring, which are few at any size; rings that hold more are split by hash.
    """
    widest = tabled.agg(F.max("own")).first()[0] or 1.0
    ringed = tabled.withColumn("ring", F.least(F.floor(F.col("own") / F.lit(widest / rings)), F.lit(rings - 1)).cast("int"))
    rows, number, plan = sorted(ringed.groupBy("cell", "ring").count().collect()), 0, []
    held, at = 0, None
    for cell, ring, n in rows:
        if cell != at or held + n > block:
            number, held, at = number + 1, 0, cell
        parts = ceil_div(n, block)
        plan.append((cell, ring, number, parts))
        held, number = (held + n, number) if parts == 1 else (block, number + parts - 1)
    spark = tabled.sparkSession
    places = spark.createDataFrame(plan, "cell int, ring int, first int, parts int")  # a row a cell and ring
    return ringed.join(F.broadcast(places), ["cell", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")).drop("cell", "ring", "own", "first", "parts")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 32, block: int = 1024, first: int = 2, page: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every`, the k best of all other rows."""
    spark = vectors.sparkSession
    points = vectors.select(F.col(id_col).cast("long").alias("vec_id"), components(vector_col, scale).alias("v")).where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    points = written(points.select("vec_id", "v", norm.alias("norm")), "points")
    n, n_queries, dim, longest = points.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.max("norm")).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = matrix([r[0] for r in points.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(pivots).select("v").collect()], dim)

    def tables(batches):
        for batch in batches:
            v = matrix(batch.column(1), dim)
            far = pivot_table(v, chosen, longest, False).astype(np.float32)
            rows = [far, pivot_table(v, chosen, longest, True).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1)), *(pa.array(list(t), pa.list_(pa.float32())) for t in rows)], ["vec_id", "v", "cell", "own", "as_candidate", "as_query"])

    tabled = written(points.select("vec_id", "v").mapInArrow(tables, "vec_id long, v array<long>, cell int, own float, as_candidate array<float>, as_query array<float>"), "pivots")
    placed = written(blocks_of(tabled.drop("as_query"), block), "blocks")
    at = lambda i: F.get("as_candidate", F.lit(i))
    bounds = placed.groupBy("block").agg(F.array(*(F.min(at(i)) for i in range(len(chosen)))).alias("low"), F.array(*(F.max(at(i)) for i in range(len(chosen)))).alias("high"))
    bounds = written(bounds, "bounds")
    groups, pages = ceil_div(n_queries, page), ceil_div(bounds.count(), page)
    queries = tabled.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.col("as_query").alias("row"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(groups)).cast("int").alias("qb"))
    every_page = F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb")
    paged = bounds.select(every_group, F.pmod("block", F.lit(pages)).cast("int").alias("page"), "block", "low", "high")

    def table_of(column) -> np.ndarray:
        return np.array(column.to_pylist(), np.float32).reshape(-1, len(chosen))

    def wanted(reach):
        def meet(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({"vec_id": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "bound": pa.array([], pa.float64())})
            rows, low, high = table_of(left["row"]), table_of(right["low"]), table_of(right["high"])
            norms = (matrix(left["v"], dim).astype(float) ** 2).sum(axis=1)
            ids, blocks, floors = left["vec_id"].to_numpy(), right["block"].to_numpy(), left["floor"].to_numpy()
            out = []
            for i, row in enumerate(rows):
                gaps = np.maximum(np.maximum(row - high, low - row).max(axis=1), 0).astype(float)
                bound = upper(norms[i], gaps, longest)
                at = np.lexsort((blocks, -bound))[:first] if reach else np.flatnonzero(bound >= floors[i])
                out.append((np.full(len(at), ids[i]), blocks[at], bound[at]))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["vec_id", "block", "bound"])

        return meet

    def asked(rows: DataFrame, reach: bool) -> DataFrame:
        """vec_id, block, bound of the blocks that queries (with floor) go to."""
        sides = rows.select("vec_id", "v", "row", "floor", "qb", every_page).groupBy("qb", "page").cogroup(paged.groupBy("qb", "page"))
        return sides.applyInArrow(wanted(reach), "vec_id long, block int, bound double")

    def scored(visits: DataFrame, rows: DataFrame) -> DataFrame:
        """query_id, vec_id, score from visits (vec_id, block) of queries (with floor)."""
        going = written(visits.join(rows, "vec_id").select("block", "qb", "vec_id", "v", "row", "floor"), "visits")
        met = written(going.select("block", "qb").distinct(), "met")
        offered = placed.join(met, "block").select("block", "qb", "vec_id", "v", F.col("as_candidate").alias("row"))

        def meet(left, right):
            rows = []
            if left.num_rows and right.num_rows:
                (q_ids, q, q_table), (c_ids, c, c_table) = ((t["vec_id"].to_numpy(), matrix(t["v"], dim), table_of(t["row"])) for t in (left, right))
                rows, _ = best(q_ids, q, c_ids, c, q_table, c_table, longest, k, left["floor"].to_numpy())
            columns = list(zip(*rows)) if rows else [()] * 3
            return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

        return going.groupBy("block", "qb").cogroup(offered.groupBy("block", "qb")).applyInArrow(meet, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    start = queries.withColumn("floor", F.lit(float("-inf")))
    by_bound = Window.partitionBy("vec_id").orderBy(F.desc("bound"), "block")
    begun = written(asked(start, True).withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= first).select("vec_id", "block"), "begun")
    head = written(top(scored(begun, start)), "head")
    floors = head.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("least")).withColumnRenamed("query_id", "vec_id")
    known = written(queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf")))).drop("least"), "floors")
    others = asked(known, False).join(begun, ["vec_id", "block"], "left_anti").select("vec_id", "block")
    found = scored(written(others, "others"), known).unionByName(head.select("query_id", "vec_id", "score"))
    return top(found).select("query_id", "rank", "vec_id", "score")
