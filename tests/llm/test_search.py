"""Top-k search and URL filters against brute force."""

import math
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from aerolith.llm import queries, topk, url_filter


def test_top_k(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(100000, [0.1, None]), (100050, [float("nan")] * 64), (None, [0.1] * 64), (100100, None), *((100150 + i, [0.5] * 64) for i in range(6)), (100155, [0.5] * 64), (100200, [0.3, -0.2]), (100250, [])]
    rows = e.union(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.top_k(rows, block=32, page=4).collect()))
    vectors = {}
    for r in rows.collect():
        if r.vec_id is None or r.embedding is None or any(x is None or not np.isfinite(x) for x in r.embedding):
            continue
        vectors[r.vec_id] = np.zeros(64, np.int64)
        vectors[r.vec_id][: len(r.embedding)] = np.floor(256 * np.array(r.embedding, np.float64))
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    expected = []
    for i, v in zip(ids, m):
        if i % 50 == 0:
            s = m @ v
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
            expected += [(int(i), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(best)]
    assert got == sorted(expected)
    assert sorted(map(tuple, topk.top_k(rows).collect())) == sorted(expected)
    assert topk.top_k(rows.limit(0)).count() == 0
    assert topk.top_k(rows.where("vec_id = 0")).count() == 0


def verdicts(pages, loss=0.01, weight=2.0, alphabet=64, order=4):
    """The method of the URL filter in plain Python, from (host, path, rule, action) by page."""
    sorts = {}
    for host, path, _, action in pages.values():
        sorts[host + path] = {"allow": "accepted", "block": "rejected"}.get(action)
    grams = {t: [("^" * order + t + "$")[i : i + order + 1] for i in range(len(t) + 1)] for t in sorts}
    number = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    held = {t for t, s in sorts.items() if s == "accepted" and signed(number(t)) % 5 == 0}
    seen = {c: Counter() for c in ("accepted", "rejected")}
    for t, s in sorts.items():
        if s and t not in held:
            for g in grams[t]:
                for k in range(1, order + 1):
                    seen[s][g[-k - 1 :]] += 1
                    seen[s][g[-k - 1 : -1] + "\0" + str(k)] += 1

    def p(c, g):
        out = 1 / alphabet
        for k in range(1, order + 1):
            out = (seen[c][g[-k - 1 :]] + weight * out) / (seen[c][g[-k - 1 : -1] + "\0" + str(k)] + weight)
        return out

    score = {t: round(sum(math.log(p("accepted", g)) - math.log(p("rejected", g)) for g in gs) / len(gs), 4) for t, gs in grams.items()}
    threshold = np.quantile([score[t] for t in held], loss)
    return {i: action or ("allow" if score[h + q] >= threshold - 1e-9 else "block") for i, (h, q, _, action) in pages.items()}


def test_urls(spark, data):
    odd = [(-1, None), (-2, ""), (-3, "http://A.B.Net"), (-4, "HTTP://x.NET/en?q"), (-5, "a://b://c/d"), (-5, "a://b://c/d"), (-6, "s://Example.NET/en/1#x"), (-7, "s://badexample.net/en/"), (-8, "s://w.org/fr/\nx")]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(odd, "page_id long, url string")).withColumn("host", F.lit("clash"))
    rows = url_filter.url_filter(pages, queries.URL_RULES).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == pages.count()
    for r in rows:
        url = urls[r.page_id] or ""
        host, path = "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            rest = rest[cut:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(rule, kind) for kind, rule in queries.URL_RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        rule, kind = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == kind if kind else r.verdict in ("allow", "block")
    expected = verdicts({r.page_id: (r.host, r.path, r.rule, dict((b, a) for a, b in queries.URL_RULES).get(r.rule)) for r in rows})
    assert {r.page_id: r.verdict for r in rows} == expected and {r.verdict for r in rows if r.rule is None} == {"allow", "block"}
    assert {r.verdict for r in url_filter.url_filter(pages, [("allow", "org/")]).collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), queries.URL_RULES).count() == 0
