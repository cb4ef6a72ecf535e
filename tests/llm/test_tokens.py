"""Tokens (8, 9, 10): against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm.bpe import SLAB, Memo, cut, vocabulary
from tallyglass.llm.records import WordEncoder, encode_to_records, frame, frames, masked, read_sequences, write_index, write_records
from tallyglass.llm.token_counts import merged_length, token_counts
from tallyglass.llm.trie_bpe import Digester, TrieEncoder, decode, decode_ids, encode_texts, round_trip_digests

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(BYTE)


def fuzz(n):
    rng = random.Random(7)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ü", "日本", "'s", "'ll", "12", "3", "!", "!!", "<|endoftext|>", "\x1c", "\x85", "é", "🙂", "Ab", "ing", " tion", "​", "İ", ",", ".", "_"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)] + ["a" * 5000, "ab" * 2000, " " * 500, "\n" * 100 + "x"]


def test_trie_and_heap_equal_the_library(byte_lib):
    v, texts = vocabulary(BYTE), fuzz(800)
    want = [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    got = [[i for p in parts for i in p] for parts in TrieEncoder(v).encode(texts)]
    assert got == want
    assert [decode(i, v) for i in got] == [byte_lib.decode(i, skip_special_tokens=False) for i in want]
    for w in (b"", b"a", b"lower", "über".encode(), b"z" * 999):
        assert merged_length(w, v) == len(byte_lib.encode(w.decode(), add_special_tokens=False).ids)


def spaced(n):
    """Texts of characters at whose seams cuts can go wrong: spaces, stops and letters of one to four bytes."""
    rng = random.Random(11)
    parts = [*"a1.,é×÷ß_'\"“”…。、日あяё🙂¹²½", *" \n\t\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000", "\u0301", "'s", "<|endoftext|>", "  "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_cuts_at_all_kinds_of_seams(byte_lib):
    v, texts = vocabulary(BYTE), spaced(3000) + ["<|endof", "text|>", "", "<|endoftext|>"]
    got = [[i for p in parts for i in p] for parts in TrieEncoder(v).encode(texts)]
    assert got == [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    whole = pa.array([None, *texts, None, "é. b" * (SLAB // 2)])
    pieces, ends = cut(whole.slice(1), whole=v.whole)
    parts = pieces.cast(pa.large_string()).to_pylist()
    assert ["".join(parts[a:b]) for a, b in zip(ends, ends[1:], strict=False)] == [t or "" for t in whole.slice(1).to_pylist()]
    assert set(parts[ends[-2] :]) == {"é", ".", " bé", " b"} and cut(whole.slice(0, 0))[1].tolist() == [0]


class Counted(Memo):
    asked = 0

    def get(self, key):
        self.asked += 1
        return super().get(key)


def test_each_piece_is_looked_up_once_for_many_rows():
    enc = Digester(vocabulary(BYTE))
    enc.memo = Counted()
    enc.encode(["the same few words, the same few words"] * 500)
    assert enc.memo.asked == 6 and len(enc.memo) == 6  # "the" with and without a space, and four others


def test_token_counts(docs, rows, empty, byte_lib):
    got = sorted(map(tuple, token_counts(docs, BYTE).collect()), key=str)
    n = lambda t: len(byte_lib.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 512) for d, t in rows), key=str)
    assert token_counts(empty, BYTE).count() == 0


def test_round_trip(docs, rows, empty, byte_lib):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = byte_lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), h(",".join(map(str, ids))), h(byte_lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, round_trip_digests(docs, BYTE).collect()), key=str) == sorted(want, key=str)
    encoded = encode_texts(docs, BYTE)
    assert sorted((r["doc_id"], len(r["ids"])) for r in encoded.filter("doc_id < 9000").collect()) == sorted(w[:2] for w in want if w[0] is not None and w[0] < 9000)
    assert {(r["doc_id"], r["text"]) for r in decode_ids(encoded, BYTE).collect()} == {(d, t or "") for d, t in rows}
    assert round_trip_digests(empty, BYTE).count() == 0


def test_frames():
    data = frame(5, np.array([1, 2, 65535], "<u2").tobytes(), 2) + b"\n" + frame(None, b"", 4) + b"\n"
    assert [(at, n, d, ids.tolist()) for at, n, d, ids in frames(data)] == [(0, 33, 5, [1, 2, 65535]), (33, 27, None, [])]
    for k in (0, 9, 20, 30):
        with pytest.raises(ValueError):
            list(frames(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]))
    assert masked(b"a") != masked(masked(b"a"))


def test_records(spark, docs, rows, empty, tmp_path):
    lib = Tokenizer.from_file(WORD)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = encode_to_records(docs, WORD).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert encode_to_records(empty, WORD).count() == 0


def test_words_at_all_kinds_of_seams():
    enc, texts = WordEncoder(WORD), [*spaced(3000), *fuzz(300), "<|startof", "text|>", ""]
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, f"<u{enc.width}").tolist() for x in enc.encode(pa.array([*texts, None]))] == [*want, []]


def test_each_word_is_looked_up_once_for_many_rows():
    enc = WordEncoder(WORD)
    enc.memo = Counted()
    got = enc.encode(pa.array(["the same few words, the same few words"] * 500))
    assert enc.memo.asked == 6 and len(set(map(bytes, got))) == 1  # four words, the comma and the space
    enc.memo = Counted(max_keys=3)  # holds nothing for long
    assert list(map(bytes, enc.encode(pa.array(["the same few words, the same few words"] * 2)))) == list(map(bytes, got[:2]))


def test_shuffled_reads(spark, docs, tmp_path):
    root = f"file://{tmp_path}/r"
    write_records(docs.filter("doc_id < 100"), root, WORD, 1)
    index = write_index(spark, root)
    some = index.filter("doc_id % 7 = 3")
    got = {r["doc_id"]: len(r["ids"]) for r in read_sequences(spark, root, some).collect()}
    assert got == {r["doc_id"]: r["n_tokens"] for r in some.collect()} and len(got) > 5
    assert read_sequences(spark, root).count() == index.count()
    ranked = [(r["rank"], r["doc_id"], list(r["ids"])) for r in read_sequences(spark, root, some.withColumn("turn", F.xxhash64("doc_id")), "turn").collect()]
    assert [r[0] for r in ranked] == sorted(r[0] for r in ranked) and [r[1] for r in ranked] == [r["doc_id"] for r in some.orderBy(F.xxhash64("doc_id")).collect()]
    assert {d: len(ids) for _, d, ids in ranked} == got
