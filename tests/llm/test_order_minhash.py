"""Order MinHash: the query's digests, and what its likeness must notice."""

import hashlib
import random

from pyspark.sql import functions as F

from framekit.llm import order_minhash as om
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sketches(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r.i: r.s for r in om.with_sketches(df, "text", "s").collect()}


def near(spark, a, b):
    df = om.with_sketches(om.with_sketches(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    return df.select(om.likeness(F.col("x"), F.col("y"))).first()[0]


def brute(text):
    """The same fingerprint by loops, but for the hash function: numbered k-mers and their order by position."""
    import re

    units = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", text):
        signs = len(run.rstrip(" \t\n\x0b\f\r"))
        alone = max(0, signs - om.WORD)
        units += [*run[:alone], run[alone:]]
    grams = [tuple(units[i : i + om.K]) for i in range(len(units))]
    seen, out = {}, []
    for place, g in enumerate(grams):
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g], place))
    return out


def test_sketches_equal_a_loop_over_numbered_kmers(spark):
    rng = random.Random(4)
    texts = ["abc abc abc abc " * 30, "x" * 500, "one two three four five six", "", "   ", "".join(rng.choice("ab c") for _ in range(3000)), "é中 🎉 ok"]
    got = sketches(spark, texts)
    mask = (1 << 64) - 1
    for i, text in enumerate(texts):
        rows = brute(text)
        bits = len(f"{len(rows):b}")
        if not rows:
            assert got[i] == []
            continue
        df = spark.createDataFrame([(list(g), n, p) for g, n, p in rows], "g array<string>, n int, p int")
        df = df.withColumn("h", F.xxhash64(*(F.when(F.size("g") > j, F.xxhash64(F.get("g", F.lit(j)))) for j in range(om.K))))
        low = F.call_function("shiftright", F.call_function("shiftleft", F.col("h"), F.lit(bits)), F.lit(bits)).bitwiseAND(F.lit(0xFFFFFFFF))
        numbered = [(r.m, r.p, r.h) for r in df.select(F.xxhash64(low, "n").alias("m"), "p", "h").collect()]
        bins = {}
        for m, place, h in numbered:
            packed = (m & ~((1 << bits) - 1)) | place
            bins.setdefault((m & mask) >> (64 - om.BIN_BITS), []).append((packed, place, h))
        want = {}
        for b, items in bins.items():
            want[b] = [h for _, _, h in sorted(sorted(items)[: om.TUPLE], key=lambda x: x[1])]
        hashed = spark.createDataFrame(list(want.items()), "b long, t array<long>").select(
            F.concat(F.lpad(F.hex("b"), 2, "0"), F.lpad(F.hex(F.xxhash64("t")), 16, "0")),
        )
        assert sorted(got[i]) == sorted(r[0] for r in hashed.collect()), text[:20]


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    small = " ".join(words[:200] + ["changed"] + words[201:])
    moved = " ".join(words[200:] + words[:200])
    other = " ".join("".join(rng.choice("mnopqrstuvw") for _ in range(6)) for _ in range(400))
    assert near(spark, text, text) == 1.0 and near(spark, "", None) == 1.0 and near(spark, text, "") == 0.0
    assert near(spark, text, small) > near(spark, text, moved) > near(spark, text, other)
    assert near(spark, text, other) < 0.05


def test_one_sign_moves_little_in_texts_without_blanks(spark):
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))
    for edited in ("好" + text, "好好好" + text, text[:450] + "好" + text[450:], text[1:]):
        assert near(spark, text, edited) > 0.8
    assert near(spark, text, text[450:] + text[:450]) < 0.99


def test_next_document_crosses_blocks_and_wraps(spark, monkeypatch):
    monkeypatch.setattr(om, "ORDER_BITS", 2)
    monkeypatch.setattr(om, "TOP_BLOCKS", 2)
    ids = [None, -9, 0, 1, 3, 4, 5, 5, 90, 1000, 1001, 40000]
    df = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = {r.text: r.next_text for r in om.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {f"t{i}": f"t{(i + 1) % len(ids)}" for i in range(len(ids))}
    single = om.with_next(df.filter("doc_id = 90"), "doc_id", ["text"]).collect()
    assert [(r.text, r.next_text) for r in single] == [("t8", "t8")]
    assert om.with_next(df.limit(0), "doc_id", ["text"]).count() == 0


def test_query_on_all_documents(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in QUERIES["op1_order_minhash"](spark, SF).collect()}
    assert len(rows) == len(docs)
    of_text = {}
    for i, (doc, text) in enumerate(docs):
        tail = len(text) // 4
        edited = text[: len(text) - tail] + docs[(i + 1) % len(docs)][1][:tail]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert of_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (edited != text or r.near_edited == 1)
        assert len(text) < 60 or r.near_edited > r.near_next
    plan = QUERIES["op1_order_minhash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
