"""Operator 10: substring dedup by level-wise doubling.

Windows of `window` words that start at two places or more are found level by level: stretches repeated at 9 words are
extended to 18, those repeated there to 35 (the last step stops at the window), until no candidates survive. Only
candidates go on to the next level; see windows.py for how a level deals them. A word is removed if a repeated window
covers it, at every place, the first included.

Defined results: null or empty texts have no words; texts under `window` words lose none; repeated rows repeat each
other's windows and lose them all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import windows
from aerolith.llm.shared import doc_key


def doubling(window: int, first: int = 9) -> tuple[int, ...]:
    """Lengths of the levels: first, its doubles, and the window."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return (*out, window)


def _kept(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = windows.words_of(text.as_py())
                ranges = windows.covered(len(words), spans.as_py(), window)
                rest = b" ".join(w for part in windows.outside(words, ranges) for w in part)
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in ranges))
                kept.append(((rest.decode() if ranges else text.as_py()) if with_text else hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, window: int = 35, first: int = 9, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (unchanged where nothing was removed) or kept_sha256."""
    keyed = docs.select(*doc_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judged = windows.repeated_windows(keyed.select("k_id", "k_th", "text"), "words", window, doubling(window, first))
    marked = windows.with_spans(keyed, judged, ["doc_id"])
    last = "kept_text" if with_text else "kept_sha256"
    return marked.mapInArrow(_kept(window, with_text), f"doc_id long, n_words long, n_removed long, {last} string")


def without_repeats(docs: DataFrame, window: int = 35, first: int = 9, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with all their columns; texts that lose words keep the rest, joined by single spaces, and size_col follows."""
    keyed = docs.select(*doc_key(id_col, text_col), F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    judged = windows.repeated_windows(keyed.select("k_id", "k_th", "text"), "words", window, doubling(window, first))
    marked = windows.with_spans(keyed.select("k_id", "k_th", "row", F.col("row")[text_col].alias("text")), judged, ["row"])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = []
            for text, spans in zip(columns[at], batch.column(1)):
                text, spans = text.as_py(), spans.as_py()
                if spans:
                    words = windows.words_of(text)
                    text = b" ".join(w for part in windows.outside(words, windows.covered(len(words), spans, window)) for w in part).decode()
                texts.append(text)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    out = marked.select("row", "spans").mapInArrow(run, docs.schema)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out
