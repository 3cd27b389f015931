"""Operator 12: toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all sequences of four characters that both hold in order, the products of decay ** (characters left out
between them); at most `gap` are left out, so an insult with characters inserted or left out still shares most of its sequences. Characters are lower-cased
and fall into 32 classes: a to z, five classes of other letters, and one of all that is not a letter, runs of which count once. Letters
spelled out one by one are joined. A sentence is cut into overlapping stretches of `WIDTH` characters, as its length would drown an insult.

Landmarks are words of labelled stretches. A stretch is mapped to its kernels with the landmarks, whitened by their own kernel
matrix (Nyström), and a linear machine with squared hinge loss is fitted to these features by Newton steps. As it is linear in the
kernels, its value of a stretch is the sum of one weight a sequence, so that scoring is lookups in one table of 2 ** 20 weights,
whatever the number of landmarks. Sequences of a word said over and over count once. A text scores as its stretch of highest value, through a logistic curve fitted on labelled documents
that the machine has not seen.

Training is bounded and distributed: at most `sample` labelled documents a label, those of smallest id hash, are written as a table; every
later step sends counts, words or landmark features of a few stretches a document to the driver, never texts. Stretches are those that the table of
the step before values most: first log ratios of counted sequences, then the machine of the round before, as a toxic text is mostly clean.

Defined results: null and empty texts score as a text without letters; repeated rows score alike; without labels of both kinds all scores are 0;
a document whose id is null is never held out and never trained on; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, written

ORDER, GAP, DECAY, BITS = 4, 2, 0.8, 5
TAIL = ORDER + GAP - 1
TABLE = 1 << (ORDER * BITS)
#: Half a stretch: stretches are WIDTH long and begin at each multiple of HALF.
HALF = 16
WIDTH = 2 * HALF
#: (offsets of the second to last character, weight) of the sequences that begin at one place.
PATTERNS = [(at, DECAY ** (at[-1] - ORDER + 1)) for at in combinations(range(1, ORDER + GAP), ORDER - 1)]
_POINTS = np.arange(1 << 16)
#: Characters of a text, and places, handled at once.
SLICE = 1 << 20
CLASS = np.where(_POINTS < 192, 0, 27 + _POINTS % 5).astype(np.uint8)
CLASS[97:123] = np.arange(1, 27)
CLASS[0x2000:0x3040] = 0
CLASS[[0xD7, 0xF7]] = 0


def letters(text: str) -> np.ndarray:
    """Classes of the characters, runs of non-letters once, single letters joined."""
    parts = [np.zeros(1, np.uint8)]
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le"), np.uint32)
        parts.append(CLASS[np.minimum(points, 65535)])
    c = np.concatenate((*parts, parts[0]))
    gap = c == 0
    c = c[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    if len(c) > 4:
        gap = c == 0
        single = gap[:-2] & ~gap[1:-1] & gap[2:]  # of the place behind
        between = np.zeros(len(c), bool)
        between[2:-2] = single[:-2] & single[2:]
        c = c[~between]
    return c


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, each begun at a multiple of HALF and padded; and the first half stretch of each."""
    sizes = np.array([len(t) // HALF + 2 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()) * HALF + TAIL, np.uint32)
    for t, s in zip(texts, starts):
        out[s * HALF : s * HALF + len(t)] = t
    return out, starts


def sequences(c: np.ndarray):
    """(number, weight) of the sequence that begins at each place, for each pattern."""
    n = len(c) - TAIL
    first = c[:n] << np.uint32(3 * BITS)
    shifted = [c << np.uint32(BITS * (ORDER - 2 - i)) for i in range(ORDER - 1)]
    for at, weight in PATTERNS:
        out = first | shifted[0][at[0] : at[0] + n]
        for i in range(1, ORDER - 1):
            out |= shifted[i][at[i] : at[i] + n]
        yield out, weight


def again(numbers: np.ndarray) -> np.ndarray:
    """Places of unbroken sequences that also began within HALF places before, as in a word said over and over: these count once."""
    out = np.zeros(len(numbers), bool)
    for back in range(2, HALF + 1):
        out[back:] |= numbers[back:] == numbers[:-back]
    return out


def values(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Value of the sequences that begin at each place."""
    total = repeated = None
    for numbers, weight in sequences(c):
        got = table[numbers]
        got *= np.float32(weight)
        total, repeated = (got, again(numbers)) if total is None else (total + got, repeated)
    total[repeated] = 0
    return total


def stretches(c: np.ndarray, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Value of the stretch that begins at each half stretch. A text's last half stretch is padding, and sees the next text only: it counts as 0."""
    halves = [np.zeros(0, np.float32)]
    for at in range(0, len(c) - TAIL, SLICE):
        back = min(at, HALF)
        found = values(c[at - back : at + SLICE + TAIL], table)[back:]
        halves.append(np.add.reduceat(found, np.arange(0, len(found), HALF)))
    found, last = np.concatenate(halves), np.append(starts[1:], (len(c) - TAIL) // HALF) - 1
    found[last] = 0
    out = found + np.concatenate((found[1:], np.zeros(1, np.float32)))
    out[last] = 0
    return out


def best_stretches(text: str, table: np.ndarray, k: int) -> list[np.ndarray]:
    """The k stretches of highest value, each with what the sequences that begin in it may reach."""
    c, starts = laid_out([letters(text)])
    found = stretches(c, table, starts)
    return [c[j * HALF : j * HALF + WIDTH + TAIL] for j in np.argsort(-found, kind="stable")[:k]]


def highest(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The highest value of a stretch of each text."""
    out, held, size = [], [], 0

    def done():
        c, starts = laid_out(held)
        out.append(np.maximum.reduceat(stretches(c, table, starts), starts))
        held.clear()

    for t in texts:
        held.append(letters(t))
        size += len(held[-1])
        if size > SLICE:
            done()
            size = 0
    if held:
        done()
    return np.concatenate(out).astype(float) if out else np.zeros(0)


@dataclass(frozen=True)
class Weights:
    """One weight for each sequence; those that are not numbered have none. Sent to tasks as it is, unfolded there."""

    numbers: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(dense: np.ndarray) -> Weights:
        some = np.flatnonzero(dense)
        return Weights(some.astype(np.int32), dense[some].astype(np.float32))

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(TABLE, np.float32)
        out[self.numbers] = self.values
        return out

    def __reduce__(self):
        return Weights, (self.numbers, self.values)


@dataclass(frozen=True)
class Landmarks:
    """The weight that each landmark (column) gives to each of its sequences, of norm 1 a landmark, and the whitening of their kernel matrix."""

    numbers: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    white: np.ndarray

    def __reduce__(self):
        return Landmarks, (self.numbers, self.columns, self.values, np.zeros((0, 0)))  # tasks don't whiten

    @cached_property
    def keys(self) -> np.ndarray:
        return np.unique(self.numbers)

    @cached_property
    def place(self) -> np.ndarray:
        out = np.full(TABLE, -1, np.int32)
        out[self.keys] = np.arange(len(self.keys))
        return out

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros((len(self.keys), int(self.columns.max()) + 1), np.float32)
        out[self.place[self.numbers], self.columns] = self.values
        return out

    def kernels(self, stretch: np.ndarray) -> np.ndarray:
        out, fresh = np.zeros(self.weights.shape[1], np.float32), None
        for numbers, weight in sequences(stretch):
            fresh = ~again(numbers) if fresh is None else fresh
            at = self.place[numbers[fresh]]
            at = at[at >= 0]
            if len(at):
                out += np.float32(weight) * self.weights[at].sum(axis=0)
        return out

    def table(self, machine: np.ndarray) -> Weights:
        """One weight a sequence, for a machine on the whitened kernels."""
        return Weights(self.keys.astype(np.int32), (self.weights @ (self.white @ machine)).astype(np.float32))


def landmarks_of(words: list[bytes]) -> Landmarks:
    found: list[dict[int, float]] = []
    for w in words:
        c, _ = laid_out([np.concatenate(([0], np.frombuffer(w, np.uint8), [0])).astype(np.uint8)])
        sums: dict[int, float] = {}
        for numbers, weight in sequences(c):
            for n in numbers[numbers > 0].tolist():
                sums[n] = sums.get(n, 0.0) + weight
        norm = sum(x * x for x in sums.values()) ** 0.5
        found.append({n: x / norm for n, x in sums.items()})
    numbers = np.array([n for f in found for n in f], np.int32)
    columns = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    values = np.array([x for f in found for x in f.values()], np.float32)
    bare = Landmarks(numbers, columns, values, np.zeros((0, 0)))
    size, axes = np.linalg.eigh((bare.weights.T @ bare.weights).astype(float))
    kept = size > 1e-6 * size.max()
    return Landmarks(numbers, columns, values, (axes[:, kept] / np.sqrt(size[kept])).astype(np.float64))


def machine_of(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, labels of -1 and 1 weighing alike in sum, by Newton steps on its support vectors."""
    x = np.hstack((x, np.ones((len(x), 1))))
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    ridge = np.eye(x.shape[1]) / cost
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        support = y * (x @ w) < 1
        pulled = x[support] * weigh[support][:, None]
        new = np.linalg.solve(ridge + pulled.T @ x[support], pulled.T @ y[support])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def curve_of(value: np.ndarray, toxic: np.ndarray, weigh: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with smoothed targets so that parted labels give a finite slope."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x = np.column_stack((value, np.ones(len(value))))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weigh * (target - p)) - np.array([1e-3, 0]) * w
        curved = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curved, slope)
        w = w + step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class Model:
    """One weight a sequence, and the logistic curve of a text's highest stretch; no table where nothing could be learned."""

    table: Weights | None
    slope: float = 0.0
    offset: float = 0.0


#: Sequences counted together.
SLAB = 1 << 14
COUNTED = "slab int, number array<int>, clean array<int>, toxic array<int>"


def _slab(slab: int, sums: np.ndarray) -> dict:
    some = np.flatnonzero(sums.any(axis=0))
    return {"slab": slab, "number": some.tolist(), "clean": sums[0, some].tolist(), "toxic": sums[1, some].tolist()}


def _counts(batches):
    """Texts of each label that hold each sequence, by slabs of sequences; rows are (text, toxic)."""
    sums = np.zeros((2, TABLE), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c, _ = laid_out([letters(text)])
            seen = np.zeros(TABLE, bool)
            for numbers, _ in sequences(c):
                seen[numbers] = True
            sums[int(toxic)] += seen
    slabs = [_slab(i, sums[:, i * SLAB : (i + 1) * SLAB]) for i in range(TABLE // SLAB)]
    yield pa.RecordBatch.from_pylist([s for s in slabs if s["number"]], COUNTED_SCHEMA)


COUNTED_SCHEMA = pa.schema([("slab", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("number", "clean", "toxic"))])


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros((2, SLAB), np.int64)
    for r in table.to_pylist():
        total[:, r["number"]] += np.array((r["clean"], r["toxic"]))
    return pa.Table.from_pylist([_slab(table["slab"][0].as_py(), total)], COUNTED_SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, landmarks: int = 256, stretch_limit: int = 2, rounds: int = 3, cost: float = 0.1, parts: int = 12, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from at most `sample` documents of each label; labels has doc_id and toxic (0 or 1). A quarter of them fit the curve."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model(None)
    turn = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)) == 0
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select("doc_id", "toxic", turn.alias("judge"))
    # Rows that repeat an id count once, so that the bound holds.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = written(texts.groupBy("doc_id", "toxic", "judge").agg(F.max("text").alias("text")).repartition(parts, "doc_id"), "labelled")
    shown, judged = texts.where("not judge").select("text", "toxic"), texts.where("judge").select("text", "toxic")
    held = {(r["judge"], r["toxic"]): r["count"] for r in texts.groupBy("judge", "toxic").count().collect()}
    clean_n, toxic_n = held.get((False, 0), 0), held.get((False, 1), 0)
    if not clean_n or not toxic_n:
        discard(texts)
        return Model(None)
    counts = np.zeros((2, TABLE))
    slabs = shown.mapInArrow(_counts, COUNTED).groupBy("slab").applyInArrow(_summed, COUNTED)
    for r in slabs.toArrow().to_pylist():  # at most one entry a sequence
        counts[:, r["slab"] * SLAB + np.array(r["number"])] = r["clean"], r["toxic"]
    ratio = np.log((counts[1] + 0.5) / (toxic_n + 1)) - np.log((counts[0] + 0.5) / (clean_n + 1))
    table = Weights.of(np.where((counts[1] >= 3) & (ratio > 1), ratio, 0))

    def words(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {w for s in best_stretches(text, table.dense, 3) for w in s.astype(np.uint8).tobytes().split(b"\0")}
                out += [(w, toxic) for w in found if len(w) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([t for _, t in out], pa.int32())], ["word", "toxic"])

    said = written(shown.mapInArrow(words, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "words")
    lean = F.col("t") - 2 * F.col("c") * F.lit(toxic_n / clean_n)
    names = [bytes(r[0]) for r in said.orderBy(lean.desc(), "word").limit(landmarks).collect()]
    names += sorted({bytes(r[0]) for r in said.orderBy(F.desc("c"), "word").limit(landmarks).collect()} - set(names))
    discard(said)
    if not names:
        discard(texts)
        return Model(None)
    marks = landmarks_of(names)

    def features(table: Weights, of_toxic: int):
        def run(batches):
            for batch in batches:
                rows = [(toxic, marks.kernels(s).tolist()) for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in best_stretches(text, table.dense, of_toxic if toxic else stretch_limit)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["toxic", "kernels"])

        return run

    for i in range(rounds):
        # The documents shown, a few stretches each: bounded by sample.
        got = shown.mapInArrow(features(table, 1 if i else stretch_limit), "toxic int, kernels array<float>").toArrow()
        x = got["kernels"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1).astype(float)
        y = np.where(got["toxic"].to_numpy() == 1, 1.0, -1.0)
        order = np.lexsort((*x.T[:4], y))
        table = marks.table(machine_of(x[order] @ marks.white, y[order], cost)[:-1])
    # Labels that few documents carry are judged on those shown as well.
    few = min(held.get((True, 0), 0), held.get((True, 1), 0)) < 5
    values = _valued(texts.select("doc_id", "text", "toxic") if few else judged.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), table).toArrow()
    discard(texts)
    order = np.argsort(values["value"].to_numpy(), kind="stable")
    value, toxic = values["value"].to_numpy()[order], values["toxic"].to_numpy()[order] == 1
    weigh = np.where(toxic, sizes[1] / max(1, toxic.sum()), sizes[0] / max(1, (~toxic).sum())) / (sizes[0] + sizes[1]) * len(value)
    return Model(table, *curve_of(value, toxic, weigh))


def _valued(rows: DataFrame, table: Weights) -> DataFrame:
    """rows (doc_id, text, ...) with value instead of text."""

    def run(batches):
        for batch in batches:
            value = pa.array(highest([x or "" for x in batch.column(1).to_pylist()], table.dense), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], value], [batch.schema.names[0], *batch.schema.names[2:], "value"])

    kinds = [f"{c} {t}" for c, t in rows.dtypes if c != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "value double"]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every document."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model.table is None:
        score = F.lit(0.0)
        valued = keyed.select("doc_id")
    else:
        score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("value") + F.lit(model.offset))))
        valued = _valued(keyed, model.table)
    return valued.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
