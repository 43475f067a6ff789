"""Byte-level BPE and packing against the tokenizers' own libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from framekit.llm import byte_bpe, packing
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "\n\n\n", "  x  y\t\tz  ", "don't we'LL I'm", "é" * 70, "école ΣΑΣ ẞ İ", "\x1c\x1d a\x1fb \x85\xa0c d", "🎉🎉 ok", "<|endoftext|> x",
    "x" * 3000, "ab" * 20000, " " * 20000, "a1b2" * 6000, "word, word. " * 4000, "'s 't're", "中文字符" * 3000, "́ ́a", "ﬀ ǅ ʰa",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), PATTERN)


def test_tree_equals_library_on_odd_and_random_texts(bpe, library, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "b", "the ", " ", "\n", "'s", "é", "1", "!", "中", " ", "\x1f", "ing", "\r\n"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(400)]
    for leaf, window in ((8192, 64), (16, 1), (3, 2)):
        monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaf)
        monkeypatch.setattr(byte_bpe, "WINDOW_CHARS", window)
        for text in texts if leaf == 8192 else [t[:2500] for t in texts]:
            ids = bpe.encode(text)
            assert ids.tolist() == library.encode_ordinary(text), (leaf, text[:80])
            assert bpe.decode(ids) == text.encode()


def test_one_long_match_by_the_tree(bpe, library):
    rng = random.Random(5)
    for raw in ["".join(rng.choice("abcdefinst") for _ in range(n)) for n in (65, 130, 1000, 5000)] + ["aaaa" * 500, "ab" * 700]:
        assert bpe.encode_match(raw.encode()) == library.encode_ordinary(raw)


def test_columns_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 7), (None, "a b", 8), (None, "a b", 8)], "doc_id long, text string, ids int")
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r.decoded) for r in out.collect()) == [b"", b"a b", b"a b"]
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert byte_bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_query_on_all_documents(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op5_byte_bpe"](spark, SF).collect()} == want


def brute_ids(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, texts):
    """rows: doc_id, start, length, crc, doc_tokens, sequence_id, offset"""
    tokenizer = Tokenizer.from_file(WORDS)
    seen, filled = {}, {}
    for doc, start, length, crc, total, seq, offset in rows:
        ids = brute_ids(texts[doc], tokenizer)
        assert total == len(ids)
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        seen.setdefault(doc, []).append((start, length))
        filled.setdefault(seq, []).append((offset, length))
    for doc in texts:
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length > 0
            at += length
    for seq, spans in filled.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == packing.CAPACITY or seq == max(filled)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces([tuple(r) for r in QUERIES["op9_packing"](spark, SF).collect()], texts)


def test_packing_odd_texts_and_many_tasks(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, start int").repartition(5)
    rows = [(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.piece)), r.doc_tokens, r.sequence_id, r.offset) for r in packing.pack(df, WORDS).collect()]
    check_pieces(rows, dict(enumerate(ODD)))
    assert packing.pack(df.limit(0), WORDS).count() == 0
    same = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), WORDS).collect()
    assert sorted(r.offset for r in same) == [0, 2] and [r.doc_tokens for r in same] == [2, 2]


def test_packing_forgets_words_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder, tokenizer = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for text in ["One two, three. four", "five! six7 sEven", "one TWO trois"] * 2:
        assert np.frombuffer(encoder(text), "<i4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
