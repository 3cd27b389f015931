"""Repeated windows: which windows of a fixed number of units (bytes or words) start at two places or more.

Windows are dealt by anchors. The anchor of a window is the k-unit gram in it with the smallest hash, the leftmost of
equals, so it depends on the window's content alone and equal windows have equal anchors at equal offsets. Consecutive
windows with one anchor form a run; a row is made for a run, not for a window, which is about (window - k) / 2 times
fewer rows. A key is the hash of an anchor, the content of a run the hash of all units that its windows cover.

* A key found once: none of the run's windows is repeated, and the run is done.
* A content found twice or more: all its windows are repeated, and the run is done.
* Else some windows of the run may be repeated. The run goes on to a longer gram, which cuts it into shorter runs.
  One run of each content found twice goes with it where its key has other contents too, to be found again.

At the last length the gram is the window, runs are single windows, and nothing is left undecided. Keys and contents
are two independent 64-bit polynomial hashes; both must agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, written

#: Odd bases of the two polynomials, modulo 2**64, and the units hashed at a time.
BASES, CHUNK = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D), 1 << 18
ROWS = "key long, content long, k_id long, k_th long, start int, n int"
_ARROW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("k_id", pa.int64()), ("k_th", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(32)


@lru_cache(maxsize=1)
def tables() -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Powers of the bases, powers of their inverses, and a random number for each byte value."""
    out = []
    for base in [*BASES, *(pow(b, -1, 1 << 64) for b in BASES)]:
        powers = np.full(2 * CHUNK, np.uint64(base))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[:2], out[2:], mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: bytes.split() splits at exactly space, tab, \\n, \\v, \\f, \\r."""
    return (text or "").encode().split()


def codes(text: str | None, unit: str) -> np.ndarray:
    if unit == "bytes":
        return np.frombuffer((text or "").encode(), np.uint8)
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(1)), np.uint64, len(words))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(parts: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, anchor, content, part, first window, number of windows of the runs of many stretches, hashed in one go.

    The anchor is the place of the run's gram in the stretches put together.

    The stretches have at least `window` units each and less than 2 * CHUNK together.
    """
    powers, inverses, _ = tables()
    values = np.concatenate(parts)
    sizes = np.array([len(x) for x in parts])
    begins = np.cumsum(sizes) - sizes
    n, n_windows = len(values), sizes - window + 1
    owner = np.repeat(np.arange(len(parts)), n_windows)
    valid = np.arange(len(owner)) + (begins - np.cumsum(n_windows) + n_windows)[owner]  # windows inside one stretch
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers[0][:n], out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * inverses[0][: n - gram + 1])
    if gram < window:
        bits = np.uint64(20)
        places = np.arange(len(hashes), dtype=np.uint64)
        at = (_least((hashes >> bits) << bits | places, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[valid]
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count = np.diff(np.append(first, len(at)))
        anchor = at[first]
    else:
        first, count, anchor = np.arange(len(valid)), np.ones(len(valid), np.int64), valid
    np.cumsum(mixed(values) * powers[1][:n], out=sums[1:])
    begin, part = valid[first], owner[first]
    last = begin + count - 1 + window
    content = mixed((sums[last] - sums[begin]) * inverses[1][begin]) ^ count.astype(np.uint64)
    return hashes[anchor].view(np.int64), anchor, content.view(np.int64), part, begin - begins[part], count


def _stretches(n: int, window: int, spans) -> Iterator[tuple[int, int]]:
    """Unit ranges that hold the asked windows: all, or those of spans of (start, n)."""
    for start, count in [(0, n - window + 1)] if spans is None else spans:
        for a in range(start, start + count, CHUNK):
            yield a, min(a + CHUNK, start + count) - 1 + window


def extract(unit: str, window: int, gram: int, spanned: bool, plain: bool = False) -> Callable:
    """Rows of the runs in texts. With plain (bytes only) a key is the gram itself, not its hash."""

    def run(batches):
        parts: list[np.ndarray] = []
        raw: list[np.ndarray] = []
        names: list[tuple[int, int, int]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                units = codes(columns[2][i].as_py(), unit)
                if len(units) < window:
                    continue
                spans = None
                if spanned:
                    flat = columns[3][i].values
                    spans = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
                k_id, k_th = columns[0][i].as_py(), columns[1][i].as_py()
                for a, b in _stretches(len(units), window, spans):
                    if size + b - a >= CHUNK + window:
                        yield packed(parts, names, window, gram, raw)
                        parts, names, raw, size = [], [], [], 0
                    parts.append(tables()[2][units[a:b]] if unit == "bytes" else units[a:b])
                    names.append((k_id, k_th, a))
                    if plain:
                        raw.append(units[a:b])
                    size += b - a
        if parts:
            yield packed(parts, names, window, gram, raw)

    return run


def packed(parts: list[np.ndarray], names: list[tuple[int, int, int]], window: int, gram: int, raw: list[np.ndarray]) -> pa.RecordBatch:
    keys, anchor, content, part, start, count = runs(parts, window, gram)
    k_id, k_th, offset = (np.array(c, np.int64)[part] for c in zip(*names))
    if raw:
        grams = np.lib.stride_tricks.sliding_window_view(np.concatenate(raw), gram)[anchor]
        ends = np.arange(0, gram * len(grams) + 1, gram, dtype=np.int32)
        suffixes = pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(grams))])
        rest = (content, k_id, k_th, (start + offset).astype(np.int32), count.astype(np.int32))
        return pa.RecordBatch.from_arrays([suffixes, *map(pa.array, rest)], schema=_ARROW.set(0, pa.field("key", pa.binary())))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, content, k_id, k_th, (start + offset).astype(np.int32), count.astype(np.int32))], schema=_ARROW)


def keys_found_twice(rows: DataFrame) -> DataFrame:
    """Written, so that the join with it deals both sides and Spark can split a hot key."""
    return written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "twice")


def repeated_windows(docs: DataFrame, unit: str, window: int, grams: tuple[int, ...], twice: Callable[[DataFrame], DataFrame] = keys_found_twice, plain: bool = False) -> list[DataFrame]:
    """Written tables (k_id, k_th, start, n, repeated, open) whose rows with repeated hold all windows found twice.

    docs has k_id, k_th, text. grams are the lengths from the first to the window's own. twice finds the keys of
    the first length that occur more than once; with plain those keys are the grams themselves.
    """
    assert grams[-1] == window
    tables_out = []
    everything = written(docs.mapInArrow(extract(unit, window, grams[0], False, plain), ROWS.replace("key long", "key binary") if plain else ROWS), "runs")
    found = written(everything.join(twice(everything), "key", "left_semi"), "runs")
    discard(everything)
    for gram, longer in zip(grams, [*grams[1:], None]):
        contents = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k_id", "k_th", "start")).alias("one"))
        contents = written(contents, "contents")
        # Written, so that both sides of the join are dealt and Spark can split a key of very many contents.
        mixed_keys = written(contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed")
        kinds = contents.join(mixed_keys, "key", "left").select("key", "content", "copies", "one", F.coalesce("kinds", F.lit(1)).alias("kinds"))
        kinds = written(kinds.where("copies > 1 or kinds > 1"), "kinds")
        judged = found.join(kinds, ["key", "content"]).select(
            "k_id", "k_th", "start", "n", (F.col("copies") > 1).alias("repeated"),
            ((F.col("kinds") > 1) & ((F.col("copies") == 1) | (F.col("one") == F.struct("k_id", "k_th", "start")))).alias("open"),
        )
        judged = written(judged.where("repeated or open"), "judged")
        tables_out.append(judged)
        discard(found, contents, mixed_keys, kinds)
        if longer is None:
            return tables_out
        joined = docs.join(spans_of(judged.where("open")), ["k_id", "k_th"]).select("k_id", "k_th", "text", "spans")
        found = written(joined.mapInArrow(extract(unit, window, longer, True), ROWS), "runs")
    return tables_out


def spans_of(marks: DataFrame) -> DataFrame:
    """k_id, k_th, spans: an array of (start, n) for each key, each span once however many rows repeat it.

    A list has no more entries than its text has windows, so lists of a partition are smaller than its texts, and are hashed.
    """
    once = marks.select("k_id", "k_th", "start", "n").distinct()
    return once.groupBy("k_id", "k_th").agg(F.collect_list(F.struct("start", "n")).alias("spans")).hint("shuffle_hash")


def with_spans(docs: DataFrame, judged: list[DataFrame], keep: list[str]) -> DataFrame:
    """docs with column spans: array of (start, n), runs of repeated windows, null where there are none."""
    marks = judged[0].where("repeated")
    for other in judged[1:]:
        marks = marks.unionByName(other.where("repeated"))
    return docs.join(spans_of(marks), ["k_id", "k_th"], "left").select(*keep, "text", "spans")


def covered(n_units: int, spans, window: int) -> list[tuple[int, int]]:
    """Maximal unit ranges that the windows of spans cover."""
    out: list[list[int]] = []
    for start, count in sorted((s["start"], s["n"]) for s in spans or ()):
        stop = min(start + count - 1 + window, n_units)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def outside(units, ranges: list[tuple[int, int]]):
    """The slices of units that no range covers."""
    at = 0
    for a, b in ranges:
        yield units[at:a]
        at = b
    yield units[at:]
