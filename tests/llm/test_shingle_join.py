"""The shingle join against all pairs of plain Python sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from framekit.llm import shingle_join
from framekit.llm.components import components
from framekit.llm.queries import QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(texts):
    out = []
    for text in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_classes(rows):
    """rows: (id, text) with unique ids; links by an inverted index over all shingles."""
    sets = brute_sets([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def families(rng, n):
    """Texts with copies, near copies around the border of likeness, shared passages and short texts."""
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    out = ["", "  \n ", "one", "One", "one two three", "ONE two\x0bthree", "a b c d e", "a b c d e f", None]
    while len(out) < n:
        base = [word() for _ in range(rng.choice([4, 5, 6, 9, 30, 80, 200]))]
        if rng.random() < 0.3:
            base += rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(own))
    return out


def test_random_families(spark, monkeypatch):
    rng = random.Random(11)
    rows = list(enumerate(families(rng, 500)))
    want = brute_classes(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n long").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.classes(df).collect()} == want
    monkeypatch.setattr(shingle_join, "BLOCK", 3)  # large groups in blocks
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.classes(df).collect()} == want


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(5)
    for n, spread in ((3, 10), (90, 40), (200, 300)):
        base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, size=rng.integers(1, 300)), rng.integers(0, 1 << 60, rng.integers(0, spread)).astype(np.uint64)])) for _ in range(n)]
        sets += [np.unique(np.append(s, np.uint64(7))) for s in sets[::3]]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        got = list(range(len(sets)))
        for i, j in shingle_join.links_of_group(sets):
            old, new = max(got[i], got[j]), min(got[i], got[j])
            got = [new if x == old else x for x in got]
        assert got == label


def test_nulls_repeats_and_empty_table(spark):
    text = "w1 w2 w3 w4 w5 w6 w7"
    df = spark.createDataFrame([(5, text), (5, text), (3, text.upper()), (None, text), (None, None), (9, None), (9, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in shingle_join.classes(df).collect()))
    assert rows == [(0, 0, 0), (0, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3), (9, 0, 9), (9, 0, 9)]
    assert shingle_join.classes(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_shingle_join"](spark, sf).collect()} == brute_classes(rows)
