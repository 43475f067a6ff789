"""Best-fit packing: plans against exhaustive search, ids against the tokenizer's own, pieces against the documents."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framekit.llm import best_fit
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "\n\n\n", "  x  y\t\tz  ", "don't we'LL I'm", "é" * 70, "\x1c\x1d a\x1fb \x85\xa0c d", "🎉🎉 ok", "<|endoftext|> x", "a <|endoftext|>b",
    "x" * 3000, " " * 5000, "a1b2" * 6000, "word, word. " * 4000, "'s 't're", "中文字符" * 3000, "a   b", "a　 b ", "  ", "a\x0b b\x0c\n c",
]


@lru_cache(None)
def fewest(items, capacity):
    """The least number of bins for a sorted tuple of items, by search."""
    if not items:
        return 0
    first, rest = items[-1], items[:-1]
    best = len(items)
    seen = set()
    for mask in range(1 << len(rest)):
        chosen = tuple(x for i, x in enumerate(rest) if mask >> i & 1)
        if first + sum(chosen) <= capacity and chosen not in seen:
            seen.add(chosen)
            best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), capacity))
    return best


def bins_of(counts, capacity):
    """The sequences of a plan, each as a list of (offset, size)."""
    bins = defaultdict(list)
    for size, stretches in best_fit.plan(dict(counts), capacity).items():
        for number in range(counts[size]):
            first, sequence, each, offset = stretches[np.searchsorted(stretches[:, 0], number, "right") - 1].tolist()
            bins[sequence + (number - first) // each].append((offset + (number - first) % each * size, size))
    return bins


def test_reduction_keeps_the_optimum():
    rng = random.Random(8)
    reduced = 0
    for _ in range(300):
        capacity = rng.randrange(6, 30)
        items = sorted(rng.randrange(1, capacity) for _ in range(rng.randrange(1, 9)))
        counts = best_fit.Counts({s: items.count(s) for s in items})
        fixed = best_fit.reduce_by_dominance(counts, capacity)
        left = tuple(s for s in counts.sizes for _ in range(counts.of[s]))
        assert sorted([*left, *(s for pattern, times in fixed for s, k in pattern for _ in range(k * times))]) == items
        assert all(sum(s * k for s, k in pattern) <= capacity for pattern, _ in fixed)
        assert sum(times for _, times in fixed) + fewest(left, capacity) == fewest(tuple(items), capacity), (items, capacity)
        reduced += bool(fixed)
    assert reduced > 200


def test_plans_place_each_item_once_without_gaps():
    rng = random.Random(9)
    for capacity in (10, 37, 2048):
        counts = {s: rng.randrange(1, 60) for s in rng.sample(range(1, capacity), min(capacity - 1, 300))}
        bins = bins_of(counts, capacity)
        total = sum(s * n for s, n in counts.items())
        assert sorted(bins) == list(range(len(bins)))
        for pieces in bins.values():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            assert at <= capacity
        assert sum(s for pieces in bins.values() for _, s in pieces) == total
        assert len(bins) <= 1.1 * -(-total // capacity) + 1


def check_pieces(docs, found, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(
        (doc_id is None, doc_id or 0, ids) for doc_id, text in docs for ids in [[*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]]
    )
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"] is None, r["doc_id"] or 0].append(r)
        assert 0 < r["length"] <= capacity
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for nothing, doc_id, ids in expected:
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
            crc = zlib.crc32(np.array(ids[start:end], "<u4").tobytes())
            match = next(r for r in by_doc[nothing, doc_id] if (r["piece"], r["start"], r["length"], r["crc"]) == (piece, start, end - start, crc))
            by_doc[nothing, doc_id].remove(match)
    assert not any(by_doc.values())


@pytest.mark.parametrize("slots", [1, 5])
def test_pieces_of_odd_texts(spark, slots):
    from pyspark.sql import functions as F

    docs = [*enumerate(ODD), (None, "no id"), (3, "a repeated id"), (3, "a repeated id"), *((100 + i, "one hot length") for i in range(300))]
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).repartition(slots)
    check_pieces(docs, best_fit.pack(given, PATH).withColumn("crc", F.crc32("ids")).collect())


def test_empty_table(spark):
    assert best_fit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ranks_give_the_ids_of_the_file():
    encoder, tokenizer, rng = best_fit.TextEncoder(PATH, best_fit.PATTERN), Tokenizer.from_file(PATH), random.Random(6)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "é", "1", "!", "中", " ", "　", "\x1f", "ing", "\r\n", "<|endoftext|>", "\t", "\x0b"]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]:
        assert encoder(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.ranks is not None
    other = best_fit.TextEncoder(public_tokenizers.path("word_bpe_49k.json"), best_fit.PATTERN)
    assert other.ranks is None and other("One word") == other.tokenizer.encode("One word", add_special_tokens=False).ids


def test_query_packs_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = [{**r.asDict(), "crc": r["ids_crc32"]} for r in QUERIES["op13_best_fit_packing"](spark, SF).collect()]
    check_pieces(docs, found)
    total = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in found}) <= 1.02 * -(-total // 2048) + 1
