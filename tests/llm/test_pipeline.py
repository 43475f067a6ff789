"""The pipeline's stages: what goes, what stays, and that rows keep their columns."""

from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from framekit.llm import packing, shingle_join
from tests.llm.test_shingle_join import brute_classes
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.01"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    seen = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        assert name == "packing" or docs.columns == names
    kept, single, redacted, pieces = seen
    left = {r.doc_id for r in kept}
    assert len(toxic & left) <= 0.2 * len(toxic) and len(clean - left) <= 0.03 * len(clean)
    want = brute_classes([(r.doc_id, r.text) for r in kept])
    assert sorted(r.doc_id for r in single) == sorted(d for d, (_, c) in want.items() if d == c)
    before = {r.doc_id: r.text for r in single}
    assert {r.doc_id for r in redacted} == set(before) and all(r.n_chars == len(r.text) for r in redacted)
    assert all(r.text == before[r.doc_id] or "<" in r.text for r in redacted)
    import zlib
    rows = [(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.piece)), r.doc_tokens, r.sequence_id, r.offset) for r in pieces]
    check_pieces(rows, {r.doc_id: r.text for r in redacted})
    assert packing.CAPACITY == 2048


def test_toxic_documents_go_where_labels_are_enough(spark):
    sf = SF.replace("sf0.01", "sf0.1")
    kept = pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    toxic, clean = ({r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter(f"toxic = {x}").collect()} for x in (1, 0))
    assert len(toxic & left) <= 0.15 * len(toxic) and len(clean - left) <= 0.03 * len(clean)


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text), (4, text), (4, text + " more"), (7, text), (2, ""), (3, None), (None, text), (9, "alone in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in shingle_join.one_of_each(df).collect())
    assert sum(n for (d, t), n in got.items() if t and t.startswith("w0")) == 1
    assert got[2, ""] == got[3, None] == got[9, "alone in here"] == 1 and sum(got.values()) == 4
    assert shingle_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(None, one), (None, two), (None, two), (None, two + " more"), (5, one), (8, two), (8, three), (8, ""), (8, ""), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in shingle_join.one_of_each(df).collect())
    assert got == Counter([(5, one), (8, two), (8, three), (8, ""), (8, ""), (None, None), (None, "")])
    nameless = spark.createDataFrame([(None, one), (None, two), (None, two), (None, three)], "doc_id long, text string")
    assert sorted(r.text for r in shingle_join.one_of_each(nameless).collect()) == [one, two, three]


def test_clashing_column_names_stay(spark):
    from framekit.llm import pii, url_filter

    extra = {c: F.lit(c) for c in ("spans", "added", "__spans", "gone_id", "again_id", "root", "digest", "base", "node", "n", "id")}
    docs = spark.createDataFrame([(1, "mail a@b.org now"), (2, "nothing"), (2, "nothing")], "doc_id long, text string").withColumns(extra)
    for result in (pii.redact(docs), shingle_join.one_of_each(docs)):
        assert result.columns == docs.columns and all(r[c] == c for r in result.collect() for c in extra)
    assert pii.find(docs).count() == 3 and "added" in pii.find(docs).columns
    pages = spark.createDataFrame([("http://a.com/x",)], "url string").withColumns({c: F.lit(c) for c in ("__best", "__host", "__path", "suffix", "host")})
    judged = url_filter.judge_urls(pages, spark.createDataFrame([("com", "/", "block")], "host string, path string, action string")).collect()
    assert [(r["__best"], r["__host"], r["host"], r["rule"], r["verdict"]) for r in judged] == [("__best", "__host", "a.com", "com/", "block")]
