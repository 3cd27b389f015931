"""BPE and token files against the tokenizers library."""

import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import bpe, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"ab  \n\t\x0b\x0c\r\x1c\x1f\x85\xa0 　'stéßİΣσ中ñ0１²9!#%", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", " the", "  ", "th", "🎉", "\u0301"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoder_on_odd_texts():
    ours, theirs, texts = bpe.transducer(BYTE), library(BYTE), random_texts(3000, 1)
    assert ours.encode_many(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    for text in texts[:300]:
        ids = ours.encode(text)
        assert "".join(ours.decode(ids, step=2)) == theirs.decode(ids, skip_special_tokens=False)


def test_stream_emits_stable_tokens(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 256)
    ours, theirs, rng = bpe.transducer(BYTE), library(BYTE), random.Random(2)
    for _ in range(5):
        word = "".join(rng.choice("etaonrisaaabcdhlgéü") for _ in range(2500))
        data = word.encode()
        assert list(ours.stream(data[i : i + 7] for i in range(0, len(data), 7))) == theirs.encode(word, add_special_tokens=False).ids


def test_tokens_longer_than_the_buffer(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 1)
    ours = bpe.Transducer(BYTE)
    monkeypatch.setattr(ours, "lookahead", 1)
    data = b" " * 40 + b"the" + b"-" * 70
    assert b"".join(ours.bytes_of[t] for t in ours.stream([data])) == data


def test_long_texts_in_parts():
    """Stretches by spaces, special tokens and splits give the ids of the whole text."""
    theirs, rng = library(BYTE), random.Random(6)
    ours = bpe.transducer(BYTE)
    for n in range(60):
        text = "".join(rng.choice([*ALPHABET, "abcé" * 30, "   ", " \n "]) for _ in range(rng.randint(0, 300)))
        for step in (7, 50, 400):
            assert [t for part in ours.encode_parts(text, step) for t in part] == theirs.encode(text, add_special_tokens=False).ids
    assert [t for part in ours.encode_parts("ab cd") for t in part] == ours.encode("ab cd")


def test_memory_of_a_text_without_spaces():
    """20 MB without a space: far less is held than its ids as a list (about 28 bytes each) would take."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(bpe.__file__.rsplit('/aerolith', 1)[0])!r})
from aerolith.llm import bpe
b = bpe.transducer({BYTE!r})
text = "abcdefghij" * 2_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n, ids, back = bpe.Digest(b).of(b.encode_parts(text))
import hashlib
assert back == hashlib.sha256(text.encode()).hexdigest() and n > 4_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 90


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    ours, texts = bpe.Transducer(BYTE), random_texts(200, 3)
    assert [ours.encode(t) for t in texts] == bpe.transducer(BYTE).encode_many(texts)


def test_round_trip(documents, corpus, no_documents):
    theirs = library(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in corpus:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.bpe_round_trip(documents, BYTE).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    back = bpe.bpe_decode(bpe.bpe_encode(documents, BYTE), BYTE).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in corpus), key=repr)
    assert bpe.bpe_round_trip(no_documents, BYTE).count() == 0


def test_word_encoder_on_odd_texts():
    ours, theirs, texts = token_files.encoder(WORD), library(WORD), random_texts(3000, 4)
    got = [np.frombuffer(b, ours.type).tolist() for b in ours.encode_many([t.encode() for t in texts])]
    assert got == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        def call(texts, **options):
            self.texts += len(texts)
            return getattr(self.tokenizer, name)(texts, **options)

        return call


def test_new_words_are_encoded_many_at_a_time():
    """Ids of the library from few texts, also where letters become more than letters (İ), words are long, and caches turn over."""
    ours, theirs, rng = token_files.WordEncoder(WORD), library(WORD), random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghiklmnoé") for _ in range(rng.randint(3, 9))) for _ in range(1280)})
    counted = ours.tokenizer = Counted(ours.tokenizer)
    got = ours.encode_many([w.encode() for w in words])
    assert [np.frombuffer(b, ours.type).tolist() for b in got] == [e.ids for e in theirs.encode_batch(words, add_special_tokens=False)]
    assert counted.texts <= len(words) / token_files.TOGETHER + 1
    odd = ["İstanbul", "H\u0331a", "ΑΣ", "ΑΣΑ", "ªº", "ǅ", "ﬁn", "中文字", "한글", "ⅷ", "²", "é" * 60, "É" * 60 + ",", "a" * 100 + "...", "-" * 70, "'s", "it's", "<|endoftext|>", "Word<|endoftext|>,", "ß", "ẞ", "e\u0301", "\u0301e", "</w>", "w</w>"]
    for n in range(40):
        texts = [" ".join(rng.choice([*odd, *words[: 20 + n]]) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        if n % 10 == 9:
            ours.old, ours.young = ours.young, {}
        assert [np.frombuffer(b, ours.type).tolist() for b in ours.encode_many([t.encode() for t in texts])] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
        assert max(map(len, ours.young)) <= token_files.CACHED_LEN


@pytest.mark.parametrize("shards", [None, 4])
def test_token_files(spark, documents, corpus, no_documents, shards):
    theirs, start, expected = library(WORD), 0, []
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_token_files(documents, WORD, shards=shards)
    got = sorted((tuple(r) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == expected
    path = manifest.first().path
    every = list(token_files.read_records(path))
    assert [r[0] for r in token_files.read_records(path, 3, 5)] == [r[0] for r in every[3:5]]
    assert token_files.record_table(spark, manifest).count() == len(corpus)
    assert token_files.read_token_files(token_files.write_token_files(no_documents, WORD)).count() == 0


def test_damage_is_found():
    record = bytearray(token_files.record_of(7, 2, b"\x01\x02\x03\x04"))
    assert token_files.unframed(bytes(record)).endswith(b"\x01\x02\x03\x04")
    for at in (0, 9, 15, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframed(bytes(broken))
