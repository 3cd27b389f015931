"""The registered queries of this package: each applies one operator to its whole table.

Four have an SQL twin. The others have none: tokenizers, packing by a plan, XXH64 majorities and learned models are not in SQL, and
byte windows are too slow there; tests/llm compares each with a brute-force version, the library itself or an exact round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, conversations, hard_negatives, packing, quality, simhash_dedup, substring_dedup, suffix_dedup, token_files, topk, toxicity, url_filter, warc
from aerolith.llm.shared import read

#: Fixed values of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(manifest)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_files.token_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(lengths.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")), (1024, 2048, 4096))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, trusted(spark, sf_dir)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages"), URL_RULES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(read(spark, sf_dir, "pages"), least_bytes=0))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), window=200, with_bytes=False)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), window=35, with_text=False)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(read(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")))
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_files, op3_packing, op4_quality, op5_simhash, op6_topk, op7_urls, op8_warc, op9_suffixes, op10_substrings, op11_conversations, op12_toxicity, op13_hard_negatives)}

_HEX = "0123456789abcdef"
#: Base 32 of a SHA-1 in hex: every five hex digits are four characters.
_BASE32 = f"""array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((list_sum([(strpos('{_HEX}', h[5 * (i // 4) + j + 1]) - 1) << (4 * (4 - j)) FOR j IN range(5)]) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '')"""
SQL: dict[str, str] = {
    "op6_topk": """WITH v AS (SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5""",
    "op8_warc": f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM (
 SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS least, coalesce(page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY p) AND min(page_id) OVER (PARTITION BY p) IS NOT NULL, false) AS again
 FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))""",
    "op10_substrings": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (SELECT r, i, c, CASE WHEN count(*) OVER f = 35 THEN string_agg(c, ' ') OVER f END AS w FROM (SELECT r, unnest(ws) AS c, unnest(generate_series(1, len(ws))) AS i FROM d)
 WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT w FROM b WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
m AS (SELECT b.r, b.i, b.c, max(CASE WHEN t.w IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM b LEFT JOIN twice t ON b.w = t.w),
g AS (SELECT r, sum(gone) AS n_removed, sha256(coalesce(string_agg(c, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM m GROUP BY r)
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN g ON d.r = g.r""",
    "op13_hard_negatives": """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), true)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
 SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5""",
}
