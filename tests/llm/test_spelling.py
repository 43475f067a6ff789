"""Spelling variants against comparing each word with each other."""

import random
import re
import zlib
from collections import Counter

import pytest

from framekit.llm import spelling
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """``word, form, root, n, n_near, form_n`` of all words of a dict of counts."""
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else 0) for w in counts)


def rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_words(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(250):
        base = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 9)))
        counts[base] = rng.choice([3, 4, 6, 7, 12, 50, 50, 400])
    counts |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "x" * 3000: 3, "x" * 2999: 9, "x" * 1500 + "y" + "x" * 1499: 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows(spelling.variants(words)) == brute(counts)


def test_trie_nodes_stand_for_one_beginning_each(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["w"]: r for r in spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {}
    for w, row in found.items():
        assert len(row["nodes"]) == len(w)
        for i, node in enumerate(row["nodes"]):
            assert number.setdefault(w[: i + 1], node) == node
    assert len(set(number.values())) == len(number) and 0 not in number.values()
    assert sorted(words, key=lambda w: found[w]["place"]) == words


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 5:
                counts[low] += 1
    return counts


def test_counts_of_odd_texts(spark):
    docs = [
        (1, "Straße ÉCOLE école naïve×word÷words x1y2 abcde ABCDE"), (2, None), (3, ""), (None, "abcde abcde"), (1, "abcde"), (4, "Ωmega-ABCDE_abcdeĀbcdefg"),
        (5, "word " * 30000), *((i, "alpha bravo charlie delta foxtrot") for i in range(6, 120)),
    ]
    found = spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string"), lossy_every=97)
    assert {r["word"]: r["n"] for r in found.collect()} == dict(plain_counts(docs))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(empty)).count() == 0


def test_query_equals_comparing_all_words(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 3}
    assert rows(QUERIES["op12_spelling_variants"](spark, SF)) == brute(counts)
