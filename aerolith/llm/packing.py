"""Operator 3: variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest permitted sequence length. Pieces are placed by best-fit
decreasing: the longest first, each into the open bin it leaves least room in; if none has room, a bin of the permitted size of
least cost is opened (its size and overhead over the tokens that pieces of this length fill). In the end each bin is cut down
to the smallest permitted size that holds its contents.

Pieces of one length are alike, so the placement is worked out on the histogram of lengths, which has no more entries
than the largest permitted length, however many documents there are. The result is that of placing piece by piece, but for which of
equally full bins is taken. Spark
counts lengths, ranks pieces within a length (in hashed buckets, so that a hot length is dealt out), and looks up
each rank's bin in the plan.

Defined results: empty pieces (null or empty texts, without an end id) take part with length 0 and go to bin -1 with
capacity 0; repeated rows are placed each; ties in length go by hashed id; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.shared import ceil_div, written

Pattern = tuple[int, int, list[tuple[int, int]]]


def least_cost(length: int, count: int, sizes: Iterable[int], overhead: int) -> int:
    """Size of a new bin for count pieces of a length."""
    return min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / (length * min(count, s // length)), -s))


def plan(histogram: dict[int, int], sizes: tuple[int, ...], overhead: int = 0) -> list[Pattern]:
    """Bins of equal contents: final size, how many such bins, and their contents as (length, pieces of it)."""
    open_bins: dict[int, list[tuple[int, int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []

    def put(room: int, size: int, bins: int, contents: list[tuple[int, int]]) -> None:
        if room == 0:
            full.append((size, bins, contents))
            return
        if room not in open_bins:
            insort(rooms, room)
        open_bins.setdefault(room, []).append((size, bins, contents))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                size = least_cost(length, left, sizes, overhead)
                each = min(size // length, left)
                bins = left // each
                put(size - each * length, size, bins, [(length, each)])
                left -= bins * each
                continue
            room = rooms[i]
            size, bins, contents = open_bins[room].pop()
            each = min(room // length, left)
            used = min(bins, left // each)
            if bins > used:
                open_bins[room].append((size, bins - used, contents))
            elif not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            put(room - each * length, size, used, [*contents, (length, each)])
            left -= used * each
    everything = full + [b for room in sorted(open_bins) for b in open_bins[room]]
    fit = sorted(sizes)
    return [(fit[bisect_left(fit, sum(n * k for n, k in contents))], bins, contents) for _, bins, contents in everything]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Columns length, first rank, first bin, pieces a bin, offset in the bin, size; ordered by length and rank."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for size, bins, contents in patterns:
        offset = 0
        for length, each in contents:
            rank = taken.get(length, 0)
            rows.append((length, rank, first_bin, each, offset, size))
            taken[length] = rank + bins * each
            offset += length * each
        first_bin += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placed(table: np.ndarray):
    def run(batches):
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 3))
            if len(table):
                row = table[np.maximum(np.searchsorted(keys, length << 44 | rank, "right") - 1, 0)]
            else:
                row = np.zeros((len(length), 6), np.int64)
            nth = rank - row[:, 1]
            each = np.maximum(row[:, 3], 1)
            some = length > 0
            columns = (np.where(some, row[:, 2] + nth // each, -1), np.where(some, row[:, 5], 0), np.where(some, row[:, 4] + nth % each * length, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, columns)], ["doc_id", "piece", "n_tokens", "bin_id", "capacity", "bin_offset"])

    return run


def pack(lengths: DataFrame, sizes: tuple[int, ...] = (1024, 2048, 4096), overhead: int = 16, a_bucket: int = 50_000) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, capacity, bin_offset for each piece of (doc_id, n_tokens).

    Rows that repeat id, piece and length are counted, ranked as one stretch, and unfolded again, many copies in several tasks.
    """
    most = max(sizes)
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / most) - 1, F.lit(0))), lambda i: F.least(n - i * most, F.lit(most)))
    pieces = lengths.select("doc_id", F.posexplode(cut).alias("piece", "n_tokens")).groupBy("doc_id", "piece", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    pieces = written(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").agg(F.sum("copies")).collect()}  # a row a length at most
    table = slots(plan(histogram, sizes, overhead))
    buckets = max(8, ceil_div(sum(histogram.values()), a_bucket))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes_of = dealt.groupBy("n_tokens", "bucket").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("n")
    starts = written(sizes_of.select("n_tokens", "bucket", before.alias("start")), "starts")
    within = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    nth = F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    ranked = dealt.withColumn("nth", nth).join(starts, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("start") + F.col("nth")).alias("rank"), "copies")
    ranked = written(ranked, "ranked")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = ranked.where(F.col("copies") <= a_bucket)
    many = ranked.where(F.col("copies") > a_bucket).withColumn("i", upto(F.ceil(F.col("copies") / a_bucket)))
    many = many.select("doc_id", "piece", "n_tokens", (F.col("rank") + F.col("i") * a_bucket).alias("rank"), F.least(F.lit(a_bucket), F.col("copies") - F.col("i") * a_bucket).alias("copies")).repartition("rank")
    every = few.unionByName(many).withColumn("i", upto(F.col("copies"))).select("doc_id", "piece", "n_tokens", (F.col("rank") + F.col("i")).alias("rank"))
    return every.mapInArrow(_placed(table), "doc_id long, piece int, n_tokens long, bin_id long, capacity long, bin_offset long")
