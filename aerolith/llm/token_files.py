"""Operator 2: token ids in length-delimited binary records with masked checksums and an offset index.

A record is: length (8 bytes, little endian), masked crc32 of those 8 bytes (4), payload, masked crc32 of the payload
(4). A payload is doc_id (8 bytes), a null flag (1), the bytes per id (1) and the ids, two bytes each where the
vocabulary allows it, else four. The index of a shard has one 8-byte offset for each record and one for the end, so
a shuffled reader can seek to any record. The crc is CRC-32 (the one of zlib), masked by a rotation and a constant so
that checksums of data that holds checksums stay sound.

Documents are dealt by ranges of doc_id, sorted inside a range, and each task writes the shard of its range: shards in
order hold ascending doc_ids (nulls first, ties by text). A task writes under a name of its own attempt, and only the
attempt whose manifest row Spark keeps is ever read, so lost executors and second attempts do no harm.

Defined results: a null or empty text is a record with the end id alone; repeated rows are repeated records; an empty
table writes no shard and reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.bpe import byte_symbols
from aerolith.llm.shared import fresh_path, opened, written

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
HEAD, FOOT, KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<q?B")
#: Most cached words of a worker process in each of two generations, most bytes of a cached word, bytes of text encoded at a time,
#: new words that the tokenizer gets in one text.
CACHED, CACHED_LEN, AT_ONCE, TOGETHER = 800_000, 48, 1 << 20, 64
PUNCTUATION = string.punctuation.encode()
MANIFEST = "shard int, path string, n_records long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + FOOT.pack(masked(size)) + payload + FOOT.pack(masked(payload))


def record_of(doc: int | None, width: int, ids: bytes) -> bytes:
    return framed(KEY.pack(doc or 0, doc is None, width) + ids)


def unframed(data: bytes) -> bytes:
    """The payload of one record; a ValueError if a checksum or the length is wrong."""
    if len(data) < 16:
        raise ValueError("a record is cut off")
    size, crc = HEAD.unpack_from(data)
    if masked(data[:8]) != crc or len(data) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if FOOT.unpack(data[-4:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


class WordEncoder:
    """Ids of texts for a tokenizer that never lets a token cross white space: words are encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: Words of the last call that are too long to be kept.
        self.long: set[bytes] = set()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        symbols = byte_symbols()
        names = [bytes(symbols.get(c, 0) for c in t.removesuffix("</w>")).decode("utf-8", "replace") for t in self.tokenizer.get_vocab() if t not in special]
        mixed = any(a.isalnum() and b in string.punctuation for t in names for a, b in zip(t, t[1:]))
        probe = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether words may be parted from the punctuation at their end and lower-cased: no token goes from a letter on to punctuation,
        #: and case makes no difference.
        self.parts = not mixed and probe("Word") == probe("word") and probe("word,") == probe("word") + probe(",")
        #: Of each id, whether its token ends a word; None if the vocabulary doesn't mark that, or if the words of a text have other ids than alone.
        self.final: np.ndarray | None = None
        if getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>" and probe("word Words") == probe("word") + probe("Words"):
            ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and t not in special]
            self.final = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.final[ends] = True

    def encode_new(self, words: Iterable[bytes]) -> None:
        """Keeps packed ids of distinct words that are not kept yet: of the word without the punctuation at its end, and of that punctuation.

        A token never holds both letters and punctuation, so a split between them changes no id. ASCII words are
        taken in lower case, as the tokenizer does. Words that may hold a special token are left whole.
        """
        young, old = self.young, self.old
        fresh, parted = set(), []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w.isalpha() and w.islower():  # of a-z only: parted and lower-cased, it is itself
                fresh.add(w)
            else:
                core, tail = self.split(w) if self.parts and b"<|" not in w else (w, b"")
                for x in (core, tail) if tail else (core,):
                    if x not in young:
                        if x in old:
                            young[x] = old[x]
                        else:
                            fresh.add(x)
                parted.append((w, core, tail))
        young.update(self.encode_words(list(fresh)))
        for w, core, tail in parted:
            young[w] = young[core] + young[tail] if tail else young[core]
        self.long = {x for x in (*fresh, *(w for w, _, _ in parted)) if len(x) > CACHED_LEN}

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their packed ids. Words of letters go to the tokenizer many at a time, parted by spaces.

        A word makes one final token at least. So if there are as many final tokens as words, each word ends with its own; if
        not, as some letters are more than letters after normalisation, the words are encoded one by one.
        """
        texts = [w.decode() for w in words]
        alone = list(range(len(words)))
        if self.final is not None:
            alone = [i for i, t in enumerate(texts) if not t.isalpha()]
            many = [i for i, t in enumerate(texts) if t.isalpha()]
            groups = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)]
            for group, code in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(code.ids, self.type)
                ends = ((np.flatnonzero(self.final[ids]) + 1) * self.width).tolist()
                if len(ends) != len(group):
                    alone += group
                    continue
                data, begin = ids.tobytes(), 0
                for i, end in zip(group, ends):
                    yield words[i], data[begin:end]
                    begin = end
        for i, code in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)):
            yield words[i], self.packed(code.ids)

    def packed(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    @staticmethod
    def split(word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(PUNCTUATION)
        if not core or not (core[-1:].isalnum() or core[-1] > 127 and unicodedata.normalize("NFC", core.decode()).lower()[-1].isalpha()):
            return word, b""
        return core.lower() if core.isascii() else core, word[len(core) :]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of UTF-8 texts."""
        words = [t.split() for t in texts]
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.encode_new(set().union(*words).difference(self.young))
        out = [b"".join(map(self.young.__getitem__, ws)) for ws in words]
        for w in self.long:
            del self.young[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def stretches(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches in slices of about AT_ONCE bytes of text, with the texts (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        part: list[bytes] = []
        begin = held = 0
        for i in range(len(texts)):
            part.append(texts[i].as_py() or b"")
            held += len(part[-1])
            if held >= AT_ONCE:
                yield batch.slice(begin, len(part)), part
                part, begin, held = [], i + 1, 0
        if part:
            yield batch.slice(begin, len(part)), part


def _write(path: str, folder: str, end_id: int | None):
    def run(batches):
        words = encoder(path)
        end = b"" if end_id is None else np.array([end_id], words.type).tobytes()
        shard, out, offsets, n_ids = TaskContext.get().partitionId(), None, [0], 0
        fs, base = opened(folder)
        name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}"
        for batch, texts in stretches(batches, "text"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(name + ".rec")
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_many(texts)):
                record = record_of(doc, words.width, ids + end)
                out.write(record)
                offsets.append(offsets[-1] + len(record))
                n_ids += (len(ids) + len(end)) // words.width
        if out is not None:
            out.close()
            with fs.open_output_stream(name + ".idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name.rpartition('/')[2]}", "n_records": len(offsets) - 1, "n_ids": n_ids, "n_bytes": offsets[-1]}], SCHEMA)

    return run


SCHEMA = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def write_token_files(docs: DataFrame, path: str, end_id: int | None = 1, shards: int | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest: shard, path (without .rec and .idx), n_records, n_ids, n_bytes."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = keyed.repartitionByRange(shards, "doc_id") if shards else keyed.repartitionByRange("doc_id")
    return written(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(_write(path, folder, end_id), MANIFEST), "manifest")


def read_records(path: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records first to last of a shard, found by its index: doc_id and ids."""
    fs, base = opened(path)
    with fs.open_input_file(base + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    last = len(offsets) - 1 if last is None else last
    with fs.open_input_file(base + ".rec") as f:
        while first < last:
            stop = max(first + 1, min(last, int(np.searchsorted(offsets, offsets[first] + (4 << 20), "right")) - 1))
            f.seek(int(offsets[first]))
            data = f.read(int(offsets[stop] - offsets[first]))
            for i in range(first, stop):
                a, b = offsets[i] - offsets[first], offsets[i + 1] - offsets[first]
                payload = unframed(data[a:b])
                doc, null, width = KEY.unpack_from(payload)
                yield None if null else doc, np.frombuffer(payload, f"<u{width}", offset=KEY.size)
            first = stop


def _read(batches):
    for batch in batches:
        for path, first, last, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows: list[tuple] = []
            for doc, ids in read_records(path, first, last):
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield _table(rows)
                    rows = []
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in shard order), n_tokens, ids_crc32 of every record, checksums verified.

    The running start needs one number a shard: a window over the manifest, which has a row a shard. A fixed number of
    partitions keeps adaptive execution from gathering the shards, whose rows here are tiny, into one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.lit(0).cast("long").alias("first"), F.col("n_records").alias("last"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, manifest.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (without an end id) of every text."""

    def run(batches):
        words = encoder(path)
        for batch, texts in stretches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ids) // words.width for ids in words.encode_many(texts)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def record_table(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, ids (array<long>) of every record, for readers that want the ids themselves."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for doc, ids in read_records(path):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, ids array<long>")
