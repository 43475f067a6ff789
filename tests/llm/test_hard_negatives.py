"""Hard negatives against plain loops, Strassen's products against direct ones."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framekit.llm import hard_negatives
from framekit.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 65), (40, 64, 23), (64, 64, 64), (5, 0, 7)])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_products_are_exact(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def brute(rows, anchors, positives=5, negatives=3):
    """The same by loops over distinct (id, label, vector)."""
    rows = sorted(set(rows))
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2], strict=False))

    for a in (r for r in rows if anchors(r[0])):
        near = sorted((-score(a, r), r[0], r) for r in rows if r[1] == a[1] and r != a)[:positives]
        for minus, positive_id, _ in near:
            p = -minus
            fit = sorted((-score(a, r), r[0]) for r in rows if r[1] != a[1] and 50 * p <= 100 * score(a, r) <= 95 * p)[:negatives]
            out += [(a[0], positive_id, rank, i, p, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vec array<bigint>")


@pytest.mark.parametrize("cell_rows, cell_anchors, tile", [(8192, 4096, 1024), (16, 4, 5), (3, 1, 2)])
def test_equals_loops_with_a_hot_label_and_ties(spark, monkeypatch, cell_rows, cell_anchors, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "LEAF", 2)
    rng = random.Random(cell_rows)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(6), tuple(rng.randrange(-3, 6) for _ in range(7))) for i in range(120)]
    rows += rows[:9]  # repeated rows
    rows += [(500 + i, 3, rows[0][2]) for i in range(20)]  # one vector many times
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, cell_rows=cell_rows, cell_anchors=cell_anchors)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_defined_results_of_odd_rows(spark):
    given = spark.createDataFrame(
        [
            (0, 1, [1.0, 1.0], "a"), (1, 1, [1.0, 1.5], "b"), (2, 2, [0.9, 1.0], None), (3, 2, None, "d"), (4, None, [1.0, 1.0], "e"),
            (5, 2, [1.0, None], "f"), (6, 2, [1.0, float("nan")], "g"), (7, 2, [float("inf"), 1.0], "h"), (None, 2, [1.0, 1.0], "i"),
            (8, 2, [1.9], "j"), (9, 2, [], "k"), (10, 2, [1e300, 1.0], "l"),
        ],
        "vec_id long, label int, v array<double>, rank string",
    )
    rows = hard_negatives.whole_numbers(given, "vec_id", F.col("label"), "v")
    found = sorted(map(tuple, hard_negatives.mine(rows, F.col("vec_id") == 0).collect()))
    positive = 256 * 256 + 256 * 384
    assert found == [(0, 1, 1, 2, positive, 256 * 230 + 256 * 256), (0, 1, 2, 8, positive, 256 * 486)]
    assert hard_negatives.mine(rows.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(rows, F.col("vec_id") == 77).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SF).collect())) == sorted(con.execute(ORACLES["op11_hard_negatives"]).fetchall())
