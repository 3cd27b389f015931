"""Quality rules: measures against brute force, verdicts on held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def test_measures(spark, documents, corpus, no_documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(documents, labels.where("quality = 1 and toxic = 0"))
    rows = quality.quality_rules(documents, model).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in corpus), key=repr)
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in rows)
    texts = {i: t for i, t in corpus if i is not None and i >= 1000}
    assert all(abs(quality.score((texts[r.doc_id] or "").encode().split(), model) - r.score) < 1e-12 for r in rows if r.doc_id in texts)
    assert quality.keep_good(documents, model).columns == documents.columns
    assert quality.keep_good(documents, model).count() == sum(r.kept for r in rows)
    assert quality.quality_rules(no_documents, quality.fit(no_documents, labels.select("doc_id"))).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 2 = 0"))
    judged = quality.quality_rules(docs, model).join(labels.where("doc_id % 2 = 1 and toxic = 0"), "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = counts.get((1, True), 0), counts.get((0, False), 0)
    assert good / (good + counts.get((1, False), 0)) > 0.97
    assert bad / (bad + counts.get((0, True), 0)) > 0.8


def test_toxic_documents_on_held_out_labels(spark):
    """Toxic documents of good quality that hold an insult fail; held-out trusted ones pass."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("quality = 1 and toxic = 0 and doc_id % 3 > 0"))
    judged = quality.quality_rules(docs, model).join(labels.where("quality = 1 and (toxic = 1 or doc_id % 3 = 0)"), "doc_id").where("not base_failed")
    insults = "trash|pathetic|idiot|disgusting|worthless|clown|loser|scum|stupid|moron"
    rows = judged.join(docs.select("doc_id", "text"), "doc_id").selectExpr("toxic", "kept", f"text rlike '(^|[ \\\\n\\\\t])({insults})([ \\\\n\\\\t]|$)' AS insult").collect()
    clean, toxic = [r.kept for r in rows if not r.toxic], [r.kept for r in rows if r.toxic]
    insulting = [r.kept for r in rows if r.toxic and r.insult]
    print(len(clean), sum(clean), len(toxic), sum(toxic), len(insulting), sum(insulting))
    assert len(insulting) > 100 and sum(insulting) < 0.05 * len(insulting)
    assert sum(toxic) < 0.5 * len(toxic)
    assert sum(clean) > 0.99 * len(clean)


def test_verdicts_against_plain_python(spark, data):
    """Fit, score and threshold again, with dictionaries; ids above 2**53 that are equal as floats are told apart."""
    big = 1 << 60
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + (1L << 60) as doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 and toxic = 0").selectExpr("doc_id + (1L << 60) as doc_id")
    rows = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    order = [r.doc_id for r in labels.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert min(rows) >= big and len(order) > 20

    def buckets(words):
        h, m = [zlib.crc32(w.encode()) for w in words], (1 << 64) - 1
        pairs = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & m for a, b in zip(h, h[1:])]
        every = [x * 0xFF51AFD7ED558CCD & m for x in h] + [x ^ x >> 31 for x in pairs]
        return [(x ^ x >> 29) % (1 << 20) for x in every]

    found = {i: buckets(w) for i, w in rows.items()}
    raw, good = Counter(), Counter()
    for i, b in found.items():
        raw.update(b)
        if i in set(order[::2]):
            good.update(b)
    share = sum(good.values()) / sum(raw.values())
    ratio = {b: 0.0 if abs(good[b] - n * share) < 5 * (n * share) ** 0.5 else math.log((good[b] + 1) / (n * share + 1)) for b, n in raw.items()}
    score = {i: sum(ratio[x] for x in b) / (len(b) + 20) if b else 0.0 for i, b in found.items()}
    failed = {i: brute(" ".join(w))[5] for i, w in rows.items()}
    held = [score[i] for i in order[1::2] if i in score and not failed[i]]
    middle, low = np.quantile(held, [0.5, 0.002])
    threshold = middle - 1.3 * (middle - low)
    got = {r.doc_id: r for r in quality.quality_rules(docs, quality.fit(docs, labels)).collect()}
    assert all(abs(got[i].score - score[i]) < 1e-9 for i in score)
    assert {i: got[i].kept for i in got} == {i: not failed[i] and score[i] >= threshold - 1e-12 for i in got}


def test_all_trusted_documents_are_fitted(spark):
    """30,000 trusted documents: counts and threshold come from all of them, also from those whose id hash is large."""
    ids = [r.id for r in spark.range(40_000).orderBy(F.xxhash64("id"), "id").collect() if r.id < 30_000]
    late, fitted, held = set(ids[20_000:]), set(ids[::2]), set(ids[1::2])
    texts = {i: " ".join([f"w{(i * 7 + k * k) % 50}x" for k in range(9 + i % 5)] + ["late"] * (i in late) + ["junk"] * (i >= 30_000 or i % 100 == 0)) for i in range(40_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    model = quality.fit(docs, spark.range(30_000).selectExpr("id as doc_id").union(spark.range(5).selectExpr("id as doc_id")))
    raw, good = np.zeros(1 << 20), np.zeros(1 << 20)
    for i, t in texts.items():
        found = quality.features(t.encode().split(), 1 << 20)
        np.add.at(raw, found, 1)
        if i in fitted:
            np.add.at(good, found, 1)
    expected = raw * (good.sum() / raw.sum())
    ratios = np.where(np.abs(good - expected) < 5 * np.sqrt(expected), 0, np.log((good + 1) / (expected + 1)))
    assert np.allclose(model.ratios, ratios, rtol=0, atol=1e-12)
    assert model.ratios[quality.features([b"late"], 1 << 20)[0]] > 0
    scores = [quality.score(texts[i].encode().split(), model) for i in held if not brute(texts[i])[5]]
    middle, low = np.quantile(scores, [0.5, 0.002])
    assert abs(model.threshold - (middle - 1.3 * (middle - low))) < 1e-9


def test_no_trusted_or_no_matching_documents(spark):
    """Without trusted documents, or with ids that no document has, nothing but the plain rules decides."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b"), (None, None)], "doc_id long, text string")
    for trusted in (spark.range(0), spark.range(50, 60), spark.sql("select cast(null as long) as id")):
        model = quality.fit(docs, trusted.selectExpr("id as doc_id"))
        assert model.threshold == float("-inf") and not model.ratios.any()
        assert sorted(r.doc_id or 0 for r in quality.quality_rules(docs, model).where("kept").collect()) == [1]
