"""Operator 4: quality rules by a hashed n-gram log-likelihood ratio.

Every document is scored by the sum, over its hashed word unigrams and bigrams, of log(p_trusted / p_raw), divided by their
number plus `prior`: a mean that `prior` further features of ratio zero draw in, so that a few words alone don't decide. The raw
multinomial counts all documents, in one pass that sums inside a task before it shuffles; it has `buckets` entries at any input size.
A bucket whose trusted count is within `sure` standard deviations of what its raw count lets expect has the ratio 0, so that the many
rare words of a document don't drown the few that trusted documents never use; the others have `pseudo` added to both counts.
All trusted documents take part: in the order of their id hashes every other one is counted in the trusted multinomial, and
the rest are held out for the threshold, which holds for every document: `slack` times as far below the exact median of their
scores as their exact `loss` quantile is. Their ids are ranked and joined by Spark; none reach the driver. Before that, plain rules
fail a document with too few words or too many words in repeated 5-word windows.

Defined results: a null or empty text has no words and fails the rules; repeated rows are scored alike; without trusted documents
the ratio keeps all that pass the rules; an empty table gives an empty table; other columns are ignored by
quality_rules and kept by keep_good.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, written
from aerolith.operators import quantiles

#: Fixed value: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
REPEATED = 5


@dataclass(frozen=True)
class Model:
    """log ratio of each bucket, the pseudo-count of features in the mean, the least score kept, and the plain rules."""

    ratios: np.ndarray
    prior: float
    threshold: float
    least_words: int = 10
    most_repeated: int = 20


def features(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of the word unigrams and bigrams."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((h * np.uint64(0xFF51AFD7ED558CCD), pairs ^ pairs >> np.uint64(31)))
    return ((both ^ both >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)


def score(words: list[bytes], model: Model) -> float:
    if not words:
        return 0.0
    found = features(words, len(model.ratios))
    return float(model.ratios[found].sum() / (len(found) + model.prior))


def repeated_words(words: list[bytes], width: int = REPEATED) -> int:
    """Words in windows of `width` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    kind = ids
    for i in range(1, width):  # exact: windows of i + 1 words are numbered by (window of i words, next word)
        kind = np.unique(kind[: len(ids) - i] * len(names) + ids[i:], return_inverse=True)[1]
        counts = np.bincount(kind)
        if counts.max() < 2:
            return 0
    marks = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(counts[kind] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def measures(data: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    bare = data.translate(None, BLANKS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return words, (len(words), len(bare.decode()), len(bare) - len(bare.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is found in (doc_id, text)."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                if words:
                    held.append(features(words, buckets))
                    n += len(held[-1])
                    if n > 1 << 20:
                        sums += np.bincount(np.concatenate(held), minlength=buckets)
                        held.clear()
                        n = 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    # Written, so that the shuffle files are gone before the next pass.
    table = written(texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counts")
    bucket, n = (c.to_numpy() for c in table.toArrow().columns)  # as many rows as buckets at most
    discard(table)
    out = np.zeros(buckets)
    out[bucket] = n
    return out


def _halves(trusted: DataFrame) -> DataFrame:
    """doc_id, fitted of each trusted id once: every other one in the order of the id hashes, the first included, is fitted.

    Ids are dealt by ranges of that order; one number a range, the ids in the ranges before it, turns places in a range into ranks.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    dealt = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.monotonically_increasing_id().alias("place"))
    # Of monotonically_increasing_id, the upper bits are the range and the lower 33 the place in it.
    table = written(dealt, "trusted")
    placed = table.select("doc_id", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = written(placed.join(F.broadcast(starts), "part").select("doc_id", ((F.col("start") + F.col("place")) % 2 == 0).alias("fitted")), "halves")
    discard(table)
    return out


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 20, loss: float = 0.002, slack: float = 1.3, prior: float = 20.0, sure: float = 5.0, pseudo: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model for docs; trusted has a column doc_id."""
    # A hash join pinned: no ids are broadcast at any size, and texts are not sorted.
    halves = _halves(trusted)
    fitted, held = (halves.where(half).select("doc_id").hint("shuffle_hash") for half in ("fitted", "not fitted"))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = _counts(keyed, buckets)
    good = _counts(keyed.join(fitted, "doc_id", "left_semi"), buckets)
    expected = raw * (good.sum() / max(1, raw.sum()))
    ratios = np.where(np.abs(good - expected) < sure * np.sqrt(expected), 0, np.log((good + pseudo) / (expected + pseudo)))
    free = Model(ratios if good.sum() else np.zeros(buckets), prior, float("-inf"))
    if not good.sum():
        discard(halves)
        return free
    held_out = _scored(keyed.join(held, "doc_id", "left_semi"), free, None)
    scores = written(held_out.where("not base_failed").select("score"), "scores")
    found = quantiles.overall(scores, ["score"], [0.5, loss])["score"]
    discard(scores, halves)
    if found is None:
        return free
    middle, low = found
    return Model(free.ratios, prior, middle - slack * (middle - low))


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(data: bytes, model: Model) -> tuple:
    words, counts = measures(data)
    failed = counts[0] < model.least_words or 100 * counts[4] > model.most_repeated * counts[0]
    s = score(words, model)
    return (*counts, failed, not failed and s >= model.threshold, s)


def _scored(keyed: DataFrame, model: Model, passed: list[str] | None) -> DataFrame:
    """Judgements of (doc_id, text); or, with passed, the good rows of a table whose column passed is the text."""

    def run(batches):
        for batch in batches:
            at = 1 if passed is None else batch.schema.get_field_index(passed[0])
            rows = [judge((t.as_py() or "").encode(), model) for t in batch.column(at)]
            if passed is not None:
                yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))
            else:
                columns = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

    return keyed.mapInArrow(run, COLUMNS if passed is None else keyed.schema)


def quality_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, kept, score of every document."""
    return _scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, None)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents kept, with all their columns."""
    return _scored(docs, model, [text_col])
