"""Helpers that the operators of this package share: the shared folder, written tables, document keys."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.scratch import fresh_path

#: White space that separates words, everywhere in this package: space, tab, \n, \v, \f, \r.
BLANKS = "\x20\x09-\x0d"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Jobs in this block drop their shuffle files as soon as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI, for use in tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key(id_col: str, text_col: str) -> list[Column]:
    """Key of a document row: k_id, and k_th, a 64-bit hash of the text and of whether the id is null. Rows of one key have one text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k_id"),
        F.xxhash64(F.col(id_col).isNull(), text).alias("k_th"),
    ]


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
