"""Toxicity: the kernel and its table against enumeration, held-out accuracy, changed insults, odd rows."""

import random
from itertools import combinations

import numpy as np
import pytest

from aerolith.llm import queries, toxicity

INSULTS = ["dimwit", "scoundrel", "blockhead", "wretch", "vermin"]


def plain_sequences(c):
    """(characters, weight) of all sequences, by enumeration; those at a place whose unbroken one began just before are left out."""
    out = []
    for i in range(len(c) - toxicity.TAIL):
        if any(i >= b and (c[i : i + 4] == c[i - b : i - b + 4]).all() for b in range(2, toxicity.HALF + 1)):
            continue
        for rest in combinations(range(i + 1, i + 4 + toxicity.GAP), 3):
            at = (i, *rest)
            out.append((tuple(int(c[j]) for j in at), toxicity.DECAY ** (at[-1] - i - 3)))
    return out


def kernel(a, b):
    return sum(x * y for s, x in a for t, y in b if s == t and any(s))


def test_table_equals_kernels():
    """A stretch's value in the table is the machine's weighted sum of its kernels with the landmarks, each by enumeration."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(1, 6, n).astype(np.uint8)) for n in (4, 5, 6, 7, 9)]
    marks = toxicity.landmarks_of(words)
    machine = rng.normal(size=marks.white.shape[1])
    table = marks.table(machine).dense
    shown = []
    for w in words:
        s = []
        c = np.zeros(64, int)
        c[1 : len(w) + 1] = list(w)
        for i in range(64 - toxicity.TAIL):
            for rest in combinations(range(i + 1, i + 4 + toxicity.GAP), 3):
                at = (i, *rest)
                s.append((tuple(int(c[j]) for j in at), toxicity.DECAY ** (at[-1] - i - 3)))
        merged = {}
        for t, x in s:
            if any(t):
                merged[t] = merged.get(t, 0) + x
        norm = np.sqrt(sum(x * x for x in merged.values()))
        shown.append([(t, x / norm) for t, x in merged.items()])
    for _ in range(20):
        stretch = rng.integers(0, 6, toxicity.WIDTH + toxicity.TAIL).astype(np.uint32)
        mine = plain_sequences(stretch)
        kernels = np.array([kernel(mine, s) for s in shown])
        assert np.allclose(marks.kernels(stretch), kernels, atol=1e-4)
        assert np.isclose(toxicity.values(stretch, table).sum(), kernels @ marks.white @ machine, atol=1e-3)


def test_texts_do_not_touch():
    """A text's value is the same alone, among others, and across the limit of what is handled at once."""
    rng = np.random.default_rng(4)
    table = rng.normal(size=toxicity.TABLE).astype(np.float32)
    table[0] = 0
    texts = ["", "x", "a b c d", "word " * 9, *("".join(rng.choice(list("abcde .é"), n)) for n in (15, 16, 17, 31, 32, 33, 500))]
    together = toxicity.highest(texts * 3, table)
    assert together.tolist() == [toxicity.highest([t], table)[0] for t in texts] * 3
    long = "".join(rng.choice(list("abcdefgh. "), 5000))
    whole = toxicity.highest([long], table)
    old = toxicity.SLICE
    try:
        toxicity.SLICE = 64
        assert toxicity.highest([long, *texts], table).tolist() == [*whole.tolist(), *together[: len(texts)].tolist()]
    finally:
        toxicity.SLICE = old
    assert (toxicity.letters("I d.i_o--t, an A b") == toxicity.letters("idiot AN ab")).all()
    assert toxicity.letters("é É").tolist() == [0, toxicity.CLASS[0xE9], toxicity.CLASS[0xE9], 0] and len(toxicity.letters("中文")) == 4


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    syllables = ["ta", "ri", "no", "el", "wan", "mo", "si", "ter", "ka", "lu", "be", "dor", "in", "fa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words) + ".", int(toxic)))
    changed = {"d i m w i t": 1, "dim-wit": 1, "dimxwit": 1, "s.c.o.u.n.d.r.e.l": 1, "scounndrel": 1, "block head": 1, "verrmin": 1, "wretched": 1, "VERMIN!": 1, "tarino": 0, "dorbe linfa": 0, "win": 0, "telwan": 0}
    plain = [word() for _ in range(60)]
    return docs, changed, plain


@pytest.fixture(scope="module")
def model(spark, labelled):
    docs = spark.createDataFrame([(i, t, 1.0, "n") for i, t, _ in labelled[0]] + [(0, labelled[0][0][1], 2.0, "m")], "doc_id long, text string, value double, toxic string").repartition(4)
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in labelled[0] if i % 5] + [(None, 1, 1), (7, None, 1), (10**9, 1, 0)], "doc_id long, toxic int, quality int")
    return toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, labelled, model):
    rows = [(i, t, x) for i, t, x in labelled[0] if i % 5 == 0]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t, _ in rows], "doc_id long, text string, score string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, model).collect()}
    assert sum(got[i] != x for i, _, x in rows) <= 2


def test_changed_insults(spark, labelled, model):
    _, changed, plain = labelled
    rows = [(k, " ".join([*plain[:30], text, *plain[30:]])) for k, text in enumerate(changed)]
    got = {list(changed)[r.doc_id]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    # One character inserted in the middle of a short insult takes about half of what it shares: it ranks above all that is clean, but not always above one half.
    assert min(got[t].score for t, x in changed.items() if x) > max(got[t].score for t, x in changed.items() if not x)
    assert not [t for t, x in changed.items() if got[t].predicted != x and t not in ("dim-wit", "dimxwit", "block head")]


def test_odd_rows(spark, labelled, model):
    long = "tari nola. " * 200_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + "dimwit"), (5, long + "dimwit"), (None, "x"), (6, "dimwit " * 3)]
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = [(r.doc_id, r.score, r.predicted) for r in out.collect()]
    scores = {}
    for i, s, p in got:
        assert scores.setdefault(i, s) == s and 0 <= s <= 1 and p == (s >= 0.5)
    assert len(got) == len(rows) and scores[1] == scores[2] == scores[3] and scores[4] < 0.5 < min(scores[5], scores[6])
    assert toxicity.toxicity(out.sparkSession.createDataFrame([], "doc_id long, text string"), model).count() == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 0), (99, 1)]):
        none = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}


def test_query(spark, data):
    """Held-out rows are those of crc32, every document has one row, and toxic ones score higher."""
    import zlib

    out = queries.op12_toxicity(spark, data)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    mean = lambda x: np.mean([r.score for r in rows if labels.get(r.doc_id) == x])
    assert mean(1) > mean(0) + 0.3
