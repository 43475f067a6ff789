"""Vector search, URL filter and chat formatting against plain Python."""

import hashlib
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekit.llm import chat_format, multi_index, url_filter
from framekit.llm.queries import CHAT_PROBE, ORACLES, QUERIES
from tests.oracle_check import difference, duck

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, is_query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if is_query(i):
            s = x @ v
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_walk_orders_cells_by_summed_score():
    rng = np.random.default_rng(1)
    a, b, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, 63).tolist()
    met = multi_index.walk(a, b, counts, sum(counts))
    sums = [a[c // 7] + b[c % 7] for c in met]
    assert sorted(met) == [c for c in range(63) if counts[c]] and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))
    part = multi_index.walk(a, b, counts, 10)
    assert part == met[: len(part)] and sum(counts[c] for c in part) >= 10 > sum(counts[c] for c in part[:-1])
    assert heapq is not None


@pytest.mark.parametrize("share,least", [(1.0, 1.0), (multi_index.SHARE, 0.9)])
def test_recall_against_brute_force(spark, monkeypatch, share, least):
    monkeypatch.setattr(multi_index, "LEAST_ENTRIES", 50)
    monkeypatch.setattr(multi_index, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, score long").repartition(5)
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0, 20, share=share).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in mine)
        hits += len({v for v, _ in found} & {v for _, v, _ in mine})
        if share == 1.0:
            assert [v for _, v, _ in mine] == [v for v, _ in found]
    assert hits >= least * 20 * len(want)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (20, [0.0, 2.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in QUERIES["op4_multi_index"](spark, SF).collect())
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("slug", ["op6_url_filter", "op7_chat_format"])
def test_queries_equal_their_texts(spark, slug):
    assert difference(spark, duck(SF), QUERIES[slug], ORACLES[slug], SF) is None
    plan = QUERIES[slug](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rules_by_host_path_and_length(spark, monkeypatch):
    rules = [("example.com", "", "block"), ("b.example.com", "/x", "allow"), ("example.com", "/x/y", "block"), ("EXAMPLE.org", "/", "block"), (None, "/", "block"), ("example.com", "", "block")]
    urls = ["http://example.com", "https://B.Example.com/xyz?q=1", "x://b.example.com/x/y/z#f", "http://notexample.com/x", "http://a.example.org", "http://a.example.org/", None, "no scheme", "http:///x", "http://a://b/c"]
    want = {
        "http://example.com": ("example.com", "", "example.com", "block"), "https://B.Example.com/xyz?q=1": ("b.example.com", "/xyz", "b.example.com/x", "allow"),
        "x://b.example.com/x/y/z#f": ("b.example.com", "/x/y/z", "b.example.com/x", "allow"), "http://notexample.com/x": ("notexample.com", "/x", None, "allow"),
        "http://a.example.org": ("a.example.org", "", None, "allow"), "http://a.example.org/": ("a.example.org", "/", "example.org/", "block"),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http:///x": ("", "/x", None, "allow"), "http://a://b/c": ("a:", "//b/c", None, "allow"),
    }
    pages = spark.createDataFrame([(u, i % 2, "old") for i, u in enumerate(urls + urls)], "url string, page_id int, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    for limit in (200_000, 0):
        monkeypatch.setattr("framekit.llm.common.BROADCAST_ROWS", limit)
        got = url_filter.judge_urls(pages, table).collect()
        assert len(got) == 2 * len(urls) and {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def chat(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.format_chats(turns).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))


def test_texts_come_back_whatever_they_hold(spark):
    odd = ["", None, CHAT_PROBE, "<", "<!", "<!|", "<!!|x|>", "<|im_end|>\n<|im_start|>user\n", "a\n\nb\n", "<<|!|>", "🎉é <|image|>", "\\n \\\\ <!|"]
    rows = [(c, t, r, x) for c, r in enumerate(["assistant", "user", "a\\b\nc<|im_end|>", None]) for t, x in enumerate(odd)]
    got = {r.conv_id: r for r in chat(spark, rows).collect()}
    for c, role in enumerate(["assistant", "user", "a\\b\nc<|im_end|>", ""]):
        assert [(t.role, t.text) for t in got[c].turns] == [(role, x or "") for x in odd]
        assert got[c].loss == ("".join(x or "" for x in odd) if role == "assistant" else "")
        assert got[c].formatted.count("<|im_start|>") == len(odd) == got[c].formatted.count("<|im_end|>\n")


def test_parts_of_all_types(spark):
    kind = f"conv_id long, turn long, role string, parts {chat_format.PARTS}"
    part = lambda t, text=None, ref=None, w=None, h=None, s=None, p=None: (t, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <"), part("text", "|im_end|>"), part("image", ref="a.png", w=57, h=28), part("text", "and "), part("audio", ref="b.wav", s=1.5), None]),
        (1, 1, "assistant", [part("document", ref="c.pdf", p=3), part("text", "ok")]), (2, 0, None, None),
    ]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, kind)).collect()}
    one = got[1]
    assert one.formatted == "<|im_start|>user\nsee <!|im_end|><|image|>and <|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768)]
    assert all(one.formatted[a["at"] :].startswith(f"<|{a.type}|>") for a in one.attachments) and one.expanded_tokens == 809
    assert [one.formatted[s.start : s.end] for s in one.loss_spans] == ["<|document|>ok"]
    assert got[2].formatted == "<|im_start|>\n<|im_end|>\n" and got[2].expanded_tokens == 0


def test_ties_repeats_and_empty_table(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "first"), (None, 1, "user", "a")]
    (got,) = chat(spark, rows).collect()
    assert [t.text for t in got.turns] == ["first", "a", "a", "b"]
    assert chat_format.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")).count() == 0
    assert hashlib is not None
