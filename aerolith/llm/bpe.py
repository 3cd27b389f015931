"""Operator 1: BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge across a byte boundary can be changed only by bytes within a fixed distance to its right. That distance, the
sufficient lookahead of the merge list, is computed from the list alone. The encoder reads bytes into a buffer, merges
the buffer, emits the tokens that end at least that far before its end and keeps the rest, so its memory is constant
however long the input is. The decoder turns token bytes into text with an incremental UTF-8 state machine that holds
at most three pending bytes.

Texts are read piece by piece (a space and what follows it up to the next space). A split of the vocabulary's pattern ends the
stream, so short ones never reach the lookahead: they are merged many at a time, and cached in two bounded generations because
natural text repeats them. Long ones go through the transducer. Texts of more than AT_ONCE characters are encoded, hashed and
decoded a stretch at a time.

Defined results: a null or empty text gives no ids, the hash of the empty string twice; repeated rows give repeated
rows; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most cached pieces of one worker process, in each of two generations, and most characters of a cached piece.
CACHED, CACHED_LEN = 400_000, 48
#: Bytes that the transducer reads at a time beyond its lookahead.
BLOCK = 4096
NEVER = 1 << 62
#: A space that a word follows, and one that none follows.
GAP, ODD_GAP = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")
#: Characters of text that a worker encodes at a time.
AT_ONCE = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], parts: dict[int, tuple[int, int]], size: dict[int, int]) -> int:
    """Most bytes right of a boundary that can decide whether a merge list ever merges across it.

    A merge across the boundary needs its right part whole; that part's right end stays unmerged only if no earlier
    merge takes what stood at that end: the part itself or a part on its right edge. So merges are taken in rank order,
    and each reaches as far as its right part plus the furthest reach of earlier merges that start from that edge.
    """
    reach: dict[int, int] = {}
    most = 0
    for left, right, _ in merges:
        edge, far = right, 0
        while True:
            far = max(far, reach.get(edge, 0))
            if edge not in parts:
                break
            edge = parts[edge][1]
        far += size[right]
        reach[left] = max(reach.get(left, 0), far)
        most = max(most, far)
    return most


class Transducer:
    """A byte-level BPE vocabulary with its streaming encoder and decoder."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[next(c for c, v in symbols.items() if v == b)] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, new) for r, (a, b, new) in reversed(list(enumerate(merges)))}
        self.pair = {a << 20 | b: r << 20 | new for (a, b), (r, new) in self.rank.items()}
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()], np.int64)
        self.single_of = np.array(self.single, np.int64)
        self.int_of = list(range(max(self.bytes_of) + 1))
        self.lookahead = sufficient_lookahead(merges, {n: (a, b) for a, b, n in reversed(merges)}, {i: len(b) for i, b in self.bytes_of.items()})
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens of one buffer: merges by rank, leftmost first."""
        ids, get = [self.single[b] for b in data], self.pair.get
        if len(ids) > 256:
            return self.merged_long(ids)
        ranks = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], NEVER)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate merges over linked symbols, for long buffers."""
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = rank[a, b][1], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heappush(heap, (rank[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rank:
                heappush(heap, (rank[p][0], h, *p))
        return [t for t in ids if t >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of a byte stream without split points, each as soon as it is stable.

        A token longer than what is read at a time makes the buffer grow until the token has ended.
        """
        held, size = b"", self.lookahead + BLOCK
        for chunk in chunks:
            held += chunk
            while len(held) >= size:
                part, at = held[:size], 0
                for t in self.merged(part):
                    end = at + len(self.bytes_of[t])
                    if end > len(part) - self.lookahead:
                        break
                    yield t
                    at = end
                size = self.lookahead + BLOCK if at else 2 * size
                held = held[at:]
        yield from self.merged(held)

    def merged_many(self, buffers: list[bytes]) -> list[list[int]]:
        """merged() of many short buffers at once: one merge in every unfinished buffer a round."""
        if not buffers:
            return []
        ids = self.single_of[np.frombuffer(b"".join(buffers), np.uint8)]
        owner = np.repeat(np.arange(len(buffers)), [len(b) for b in buffers])
        lasts = np.ones(len(ids), bool)
        lasts[:-1] = owner[1:] != owner[:-1]
        ranks = np.full(len(ids), NEVER)
        inner = np.flatnonzero(~lasts)
        ranks[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        out: list[list[int]] = [[]] * len(buffers)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            done = least == NEVER
            if done.any():
                for w, i, n in zip(owner[starts[done]], starts[done], sizes[done]):
                    out[w] = ids[i : i + n].tolist()
                keep = np.repeat(~done, sizes)
                ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
                least, sizes = least[~done], sizes[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))]
            ids[at] = ranks[at] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            for i in (at[at > 0] - 1, at):
                j = np.minimum(i + 1, len(ids) - 1)
                ranks[i] = np.where((i + 1 < len(ids)) & (owner[i] == owner[j]), self.ranks_of(ids[i], ids[j]), NEVER)
        return out

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        i = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == keys, self.pair_ranks[i], NEVER)

    def resolve(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pieces that are not cached; a piece that begins with a space stands at the head of a text."""
        split = {p: self.split.findall(p[1:] if p[:1] == " " else " " + p) for p in pieces}
        tokens = {t: None for found in split.values() for t in found if t not in self.tokens}
        short = [t for t in tokens if len(t) <= CACHED_LEN]
        fresh = dict(zip(short, self.merged_many([t.encode() for t in short])))
        for t in tokens.keys() - fresh.keys():
            data = t.encode()
            fresh[t] = list(self.stream(data[i : i + BLOCK] for i in range(0, len(data), BLOCK)))
        known, own = self.tokens, self.int_of.__getitem__
        out = {}
        for piece, found in split.items():
            ids = out[piece] = tuple(map(own, chain.from_iterable(fresh[t] if t in fresh else known[t] for t in found)))
            if len(piece) <= CACHED_LEN:
                self.young[piece] = ids
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        if len(known) >= CACHED:
            known.clear()
        known.update((t, fresh[t]) for t in short)
        return out

    def plain_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without special tokens. A split always falls before a space that a word follows."""
        keys = []
        for text in texts:
            parts = GAP.split(text) if ODD_GAP.search(text) else text.split(" ")
            parts[0] = " " + parts[0]
            keys.append(parts)
        found = [list(map(self.young.get, parts)) for parts in keys]
        missing = {p for parts, got in zip(keys, found) if None in got for p, ids in zip(parts, got) if ids is None}
        if missing:
            fresh = {p: self.old[p] for p in missing if p in self.old}
            self.young |= fresh
            fresh |= self.resolve(missing - fresh.keys())
            for parts, got in zip(keys, found):
                if None in got:
                    got[:] = [fresh[p] if ids is None else ids for p, ids in zip(parts, got)]
        return [list(chain.from_iterable(got)) for got in found]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, special tokens in them included."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return self.plain_many(texts)
        parts = [self.cut.split(t) for t in texts]
        plain = iter(self.plain_many([p for found in parts for p in found if p not in self.special]))
        return [list(chain.from_iterable([self.special[p]] if p in self.special else next(plain) for p in found)) for found in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encode_parts(self, text: str, step: int = AT_ONCE) -> Iterator[list[int]]:
        """Ids of a long text, a stretch at a time, so that neither its ids nor its splits are held whole.

        Stretches end at special tokens and before spaces that a word follows; one that has no such space goes split by split through
        the transducer, which holds no more of it than its buffer.
        """
        at = 0
        for a, b in [*(m.span() for m in (self.cut.finditer(text) if self.cut else ())), (len(text), len(text))]:
            while at < a:
                gap = GAP.search(text, at + step, a) if a - at > step else None
                stop = gap.start() if gap and gap.start() < a else a
                if stop - at > 2 * step:  # no space for long: up to the last one before, or from here on
                    back = next((i for i in range(at + step, at, -1) if text[i] == " " and not text[i + 1].isspace()), None)
                    if back is None:
                        yield from self.streamed(text, at, stop)
                        at = stop
                        continue
                    stop = back
                yield self.plain_many([text[at:stop]])[0]
                at = stop
            if b > a:
                yield [self.special[text[a:b]]]
                at = b

    def streamed(self, text: str, at: int, stop: int, most: int = 1 << 16) -> Iterator[list[int]]:
        """Ids of a stretch, split by split: short splits many at a time, each long one as its tokens become stable."""
        short, ids = [], []

        def flushed():
            ids.extend(chain.from_iterable(self.merged_many(short)))
            short.clear()

        for m in self.split.finditer(text, at, stop):
            if m.end() - m.start() <= CACHED_LEN:
                short.append(m.group().encode())
                if len(short) >= most:
                    flushed()
            else:
                flushed()
                for t in self.stream(text[i : min(i + BLOCK, m.end())].encode() for i in range(m.start(), m.end(), BLOCK)):
                    ids.append(t)
                    if len(ids) >= most:
                        yield ids
                        ids = []
            if len(ids) >= most:
                yield ids
                ids = []
        flushed()
        yield ids

    def decode(self, ids: list[int], step: int = 1 << 16) -> Iterator[str]:
        """Text of the ids, a stretch at a time."""
        yield from self.decode_parts(ids[i : i + step] for i in range(0, len(ids), step))

    def decode_parts(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids that come in parts; the state machine carries unfinished characters over."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One vocabulary for each worker process."""
    return Transducer(path)


def stretches(batches, column: int = 1):
    """Rows of Arrow batches in stretches of about AT_ONCE characters: the batch, the first row, the texts (null: empty)."""
    for batch in batches:
        texts, begin, held = batch.column(column), 0, 0
        part: list[str] = []
        for i in range(len(texts)):
            part.append(texts[i].as_py() or "")
            held += len(part[-1])
            if held >= AT_ONCE:
                yield batch, begin, part
                part, begin, held = [], i + 1, 0
        if part:
            yield batch, begin, part


class Digest:
    """Count and hash of ids, and hash of the text that they decode to, as ids come in."""

    def __init__(self, bpe: Transducer):
        self.bpe, self.n, self.ids, self.text = bpe, 0, hashlib.sha256(), hashlib.sha256()

    def seen(self, parts: Iterable[list[int]]) -> Iterator[list[int]]:
        for ids in parts:
            if ids:
                self.ids.update(("," * (self.n > 0) + ",".join(map(self.bpe.text_of.__getitem__, ids))).encode())
                self.n += len(ids)
                yield ids

    def of(self, parts: Iterable[list[int]]) -> tuple[int, str, str]:
        for text in self.bpe.decode_parts(self.seen(parts)):
            self.text.update(text.encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _digests(path: str):
    def run(batches):
        bpe = transducer(path)
        for batch, begin, texts in stretches(batches):
            whole = iter(bpe.encode_many([t for t in texts if len(t) <= AT_ONCE]))
            rows = [Digest(bpe).of([next(whole)] if len(t) <= AT_ONCE else bpe.encode_parts(t)) for t in texts]
            counts, codes, backs = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin : begin + len(texts)], pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        bpe = transducer(path)
        for batch, begin, texts in stretches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0)[begin : begin + len(texts)], pa.array(bpe.encode_many(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches):
        bpe = transducer(path)
        for batch in batches:
            texts = ["".join(bpe.decode(i.as_py() or [])) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_ids(path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every id list."""
    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(_texts(path), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text inside one task, moving no ids."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
