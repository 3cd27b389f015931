"""Substring, suffix and near-duplicate removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from aerolith.llm import simhash_dedup, substring_dedup, suffix_dedup, windows


def sha(data):
    return hashlib.sha256(data).hexdigest()


def marks(units, window, counts):
    out = bytearray(len(units))
    for p in range(len(units) - window + 1):
        if counts[tuple(units[p : p + window])] > 1:
            out[p : p + window] = b"\x01" * window
    return out


def counted(rows, window):
    return Counter(tuple(u[p : p + window]) for u in rows for p in range(len(u) - window + 1))


def test_substrings(spark, documents, corpus, no_documents):
    words = [(i, (t or "").encode().split()) for i, t in corpus]
    counts = counted([w for _, w in words], 35)
    expected = Counter()
    for i, w in words:
        m = marks(w, 35, counts)
        expected[i, len(w), sum(m), sha(b" ".join(x for x, y in zip(w, m) if not y))] += 1
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(documents, with_text=False).collect()) == expected
    assert sum(k[2] > 0 for k in expected) > 50
    assert substring_dedup.substring_dedup(no_documents).count() == 0


def test_suffixes(documents, corpus, no_documents):
    counts = counted([(t or "").encode() for _, t in corpus], 200)
    expected = Counter()
    for i, t in corpus:
        b = (t or "").encode()
        m = marks(b, 200, counts)
        runs = sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
        expected[i, len(b), sum(m), runs, sha(bytes(x for x, y in zip(b, m) if not y))] += 1
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(documents, with_bytes=False).collect()) == expected
    assert suffix_dedup.suffix_dedup(no_documents).count() == 0


def test_index_family(spark):
    """Levels hold powers of two of batches in byte order, and what two batches share, or one repeats, is found."""
    rng = random.Random(4)
    batches = [[bytes([rng.randrange(250, 256), rng.randrange(3)]) for _ in range(rng.randint(0, 8))] for _ in range(7)]
    family = suffix_dedup.IndexFamily()
    for b in batches:
        family.add(spark.createDataFrame([(bytearray(x),) for x in b], "key binary"))
    assert [n for n, _ in family.levels] == [4, 2, 1]
    counts = Counter(x for b in batches for x in b)
    assert {bytes(r.key) for r in family.found_twice().collect()} == {x for x, n in counts.items() if n > 1}
    assert sum(r.n for _, level in family.levels for r in level.collect()) == len(list(counts.elements()))
    for _, level in family.levels:
        for part in level.rdd.glom().collect():
            assert [bytes(r.key) for r in part] == sorted(bytes(r.key) for r in part)


def test_long_stretches_are_cut(monkeypatch, spark):
    monkeypatch.setattr(windows, "CHUNK", 64)
    windows.tables.cache_clear()
    import numpy as np

    values = (np.arange(120, dtype=np.uint64) % 7) + 1
    whole = windows.runs([values], 20, 20)
    windows.tables.cache_clear()
    assert len(whole[0]) == len(whole[1]) == 101 and len(set(whole[0].tolist())) == 7
    assert [b - a for a, b in windows._stretches(300, 20, None)][:2] == [83, 83]


def fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(documents, corpus, no_documents):
    prints = [fp(t) for _, t in corpus]
    distinct = sorted(set(prints))
    root = roots(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2])
    ids = defaultdict(list)
    for (i, _), p in zip(corpus, prints):
        ids[root[p]].append(i)
    expected = sorted(((i, p, min((x for x in ids[root[p]] if x is not None), default=None)) for (i, _), p in zip(corpus, prints)), key=repr)
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.simhash_dedup(documents).collect()), key=repr)
    assert got == expected and sum(r[0] != r[2] for r in expected) > 10
    assert simhash_dedup.simhash_dedup(no_documents).count() == 0


def test_links_of_one_and_two_bits(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ (1 << 63), base ^ 0b110 ^ (1 << 40), base ^ 0b110, (1 << 64) - 1, (1 << 64) - 1 ^ (1 << 5) ^ (1 << 63)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {frozenset(r) for r in simhash_dedup.near_links(spark.createDataFrame([(x,) for x in set(signed)], "fp long")).collect()}
    linked = roots(signed, [tuple(f) for f in found])
    assert len({linked[x] for x in signed[:5]}) == 1 and linked[signed[5]] != linked[signed[0]]


@pytest.mark.parametrize("similarity", [0.8])
def test_near_duplicates(documents, corpus, similarity, no_documents):
    sets = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    plain = [i for i in sets if i is not None and i != 5 and sets[i]]
    links = [(a, b) for n, a in enumerate(plain) for b in plain[:n] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    root = roots(plain, links)
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(documents.where("doc_id is not null and doc_id <> 5"), similarity=similarity).collect()}
    assert {i: got[i] for i in plain} == root
    assert simhash_dedup.near_duplicates(documents).count() == len(corpus)
    assert simhash_dedup.near_duplicates(no_documents).count() == 0


def test_near_duplicates_around_a_late_original(spark):
    """Copies near one original of the largest id, but not near each other."""
    rng = random.Random(1)
    original = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(5000, " ".join(original))]
    for i in range(1000):
        words = list(original)
        for k in range(6):
            words[50 * k + rng.randrange(5, 45)] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    sets = [simhash_dedup.shingle_hashes(t, 5, 42) for _, t in rows[:3]]
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert alike(sets[0], sets[1]) >= 0.8 > alike(sets[1], sets[2])
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 1001 and {r.component_id for r in got} == {0}
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows[1:], "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(1000)}


def test_recall_of_near_duplicates(spark):
    """All pairs of the larger table at a similarity of 0.8 or more, found through shared shingles: nearly all end in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(simhash_dedup.shingle_hashes(r.text, 5, 42).tolist()) for r in docs.collect()}
    places = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    shared = Counter((a, b) for at in places.values() if len(at) > 1 for n, b in enumerate(at) for a in at[:n])
    alike = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    found = sum(got[a] == got[b] for a, b in alike)
    print(len(alike), found)
    assert len(alike) > 100 and found >= 0.99 * len(alike)
    root = roots([i for i in sets if sets[i]], alike)
    assert all(got[i] >= root[i] for i in root), "texts that no chain of similar ones joins are apart"


def test_recall_of_changed_copies(spark):
    """Copies with words changed here and there, at a similarity from 0.8 to 0.95: at least nine in ten are found, and nothing else."""
    rng = random.Random(9)
    base = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) between 120 and 600").orderBy("doc_id").limit(250).collect()]
    rows = []
    for i, words in enumerate(base):
        other = list(words)
        for k in range(max(1, round(len(words) * rng.uniform(0.005, 0.02)))):
            other[rng.randrange(len(words))] = f"q{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [frozenset(simhash_dedup.shingle_hashes(t, 5, 42).tolist()) for _, t in rows]
    alike = [(a, a + 1) for a in range(0, len(rows), 2) if 0.95 >= len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = sum(got[a] == got[b] for a, b in alike)
    print(len(alike), found)
    assert len(alike) > 100 and found >= 0.9 * len(alike)


def test_copies_of_a_long_text_stay_linear(spark):
    """Spans of repeated rows are kept once a text, not once for each pair of rows."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    docs = spark.createDataFrame([(7, text)] * 300 + [(i, text) for i in range(100)], "doc_id long, text string").repartition(4)
    keyed = docs.selectExpr("doc_id as k_id", "xxhash64(text) as k_th", "text")
    judged = windows.repeated_windows(keyed, "words", 35, (9, 18, 35))
    spans = windows.with_spans(keyed, judged, ["k_id"]).selectExpr("max(size(spans))", "min(size(spans))").first()
    assert spans[0] == spans[1] < 2000
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {2000}


def test_links_across_blocks(spark, monkeypatch):
    """A group dealt in blocks: the same components as one by one."""
    monkeypatch.setattr(simhash_dedup, "MEMBERS", 4)
    rng = random.Random(2)
    sets = {i: np.unique(np.array([rng.randrange(12) for _ in range(6)], np.uint64)) for i in range(40)}
    items = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "node long, items binary")
    members = spark.createDataFrame([(0, 7, i) for i in sets], "view int, fp long, node long")
    known = spark.createDataFrame([(i, 0) for i in range(5)], "node long, root long")
    found = [(r.node, r.head) for r in simhash_dedup.links_left(members, known, items, 0.6).collect()]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(a, b) for a, b in found)
    given = [(i, 0) for i in range(5)]
    assert roots(list(sets), found + given) == roots(list(sets), [(a, b) for a in sets for b in range(a) if alike(a, b)] + given)
