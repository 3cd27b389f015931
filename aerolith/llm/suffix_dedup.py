"""Operator 9: suffix-array dedup with a logarithmic family of indexes.

Documents come in batches. Each batch gets a suffix array: the fingerprints of the first `gram` bytes of its sampled suffixes (with
`plain`, those bytes) with their number, in order inside each of the parts that they are dealt to by hash. Suffixes are sampled at anchors (windows.py), of which
every string of `window` bytes has one at a place that its own bytes fix, so any match of that length joins two sampled suffixes.
A new array is merge-scanned against every existing level: both are sorted, and what they share are matches of `gram` bytes. Then,
as long as the top level is as large as the new array in batches, the two are merged into one of twice the size, so that a suffix is
rewritten a logarithmic number of times. Matches are then extended to the whole window by denser samples of the suffixes that
have one: grams of 32, 176 and 200 bytes (for a window of 200), the last being the exact test of each window.

A byte is removed if a string of `window` bytes that starts at two places or more covers it, at every place.
Matches never cross documents. Arrays of all suffixes, and levels that keep every place instead of one row a string, are not built.

Defined results: null or empty texts have no bytes; texts under `window` bytes lose none; repeated rows repeat each
other's strings and lose them all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import windows
from aerolith.llm.shared import discard, doc_key, written


class IndexFamily:
    """Levels of sorted suffix arrays, each of a power of two of batches."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Scans a new batch's suffixes (key) against itself and all levels, then merges levels of equal size."""
        array = written(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("key"), "level")
        met = array.where("n > 1").select("key")
        for _, level in self.levels:
            met = met.unionByName(array.join(level, "key", "left_semi").select("key"))
        self.matches.append(written(met, "matches"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            merged = written(array.unionByName(level).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "level")
            discard(array, level)
            array, size = merged, 2 * size
        self.levels.append((size, array))

    def found_twice(self) -> DataFrame:
        out = self.matches[0]
        for other in self.matches[1:]:
            out = out.unionByName(other)
        return out.distinct()


def _by_batches(batches: int):
    def twice(rows: DataFrame) -> DataFrame:
        family = IndexFamily()
        for b in range(batches):
            family.add(rows.where(F.pmod("k_th", F.lit(batches)) == b).select("key"))
        found = written(family.found_twice(), "matches")
        discard(*family.matches, *(level for _, level in family.levels))
        return found

    return twice


def _kept(window: int, with_bytes: bool):
    def run(batches):
        for batch in batches:
            sizes, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                ranges = windows.covered(len(data), spans.as_py(), window)
                rest = b"".join(windows.outside(data, ranges))
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                n_spans.append(len(ranges))
                kept.append(rest if with_bytes else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, n_spans)), pa.array(kept, pa.binary() if with_bytes else pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_bytes else "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, window: int = 200, gram: int = 32, batches: int = 4, with_bytes: bool = True, plain: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) or kept_sha256."""
    keyed = docs.select(*doc_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grams = tuple(g for g in (gram, window - window // 8 + 1) if g < window) + (window,)
    judged = windows.repeated_windows(keyed.select("k_id", "k_th", "text"), "bytes", window, grams, _by_batches(batches), plain=plain)
    marked = windows.with_spans(keyed, judged, ["doc_id"])
    last = "kept binary" if with_bytes else "kept_sha256 string"
    return marked.mapInArrow(_kept(window, with_bytes), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
