"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, best-fit packing, each over all the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import packing, quality, queries, simhash_dedup, substring_dedup, token_files
from aerolith.llm.shared import written

#: No stage can be said in SQL; tests/llm/test_pipeline.py holds them against planted documents.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the ratio, unchanged. Null and empty texts fail; repeated rows pass or fail alike."""
    return quality.keep_good(docs, quality.fit(docs, queries.trusted(spark, sf_dir)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by five-word shingles and a similarity of 0.8: that of the smallest id, rows without one last.

    Rows that share an id but not a text are different documents; repeated rows are one group, and so are texts without words.
    """
    return simhash_dedup.without_near_duplicates(docs, shingle=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words or more that are found elsewhere too; n_chars follows. Null and short texts stay as they are."""
    return substring_dedup.without_repeats(docs, window=35)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, capacity, bin_offset: each document with an end id, in sequences of permitted lengths.

    A null or empty text is its end id alone; repeated rows are placed each.
    """
    lengths = token_files.token_lengths(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(lengths.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")), (1024, 2048, 4096))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
