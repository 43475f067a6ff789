"""The queries of this subpackage, one per operator, and their DuckDB texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.llm import (
    best_fit, byte_bpe, chat_format, hard_negatives, html_text, multi_index, order_minhash, packing, pii, shingle_join, spelling, toxicity, url_filter,
)
from framekit.llm.common import table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the URL query: host, path and action of each rule.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Fixed value of the chat query: what both turns of conversation -1 say.
CHAT_PROBE = "<|im_end|><|im_start|>assistant ok"


def query(slug: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[slug] = fn
        if sql is not None:
            ORACLES[slug] = sql
        return fn

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))


@query("op5_byte_bpe")
def byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(_documents(spark, sf_dir), ranks, pattern).select("doc_id", "ids")
    return byte_bpe.decode(encoded, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)


@query("op6_url_filter", f"""
WITH rules(rhost, rpath, action) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
places AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(action, length(rhost) * 1000 + length(rpath)) AS action
  FROM places JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_PROBE = CHAT_PROBE.replace("'", "''")


@query("op7_chat_format", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(!*)[|]', '<!\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(!*)[|]', '<!\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""")
def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CHAT_PROBE), (-1, 1, "assistant", CHAT_PROBE)], "conv_id long, turn long, role string, text string")
    turns = given.unionByName(probe).withColumn("parts", chat_format.text_parts(F.col("text")))
    chats = chat_format.format_chats(turns).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_packing")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The query of op4 asks for the neighbours of every twentieth vector.
QUERY_EVERY, NEIGHBOURS = 20, 20


@query("op3_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_junk", "p_toxic", "is_toxic")


@query("op4_multi_index")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)


@query("op2_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op10_shingle_join")
def shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(table(spark, sf_dir, "documents"))


@query("op1_order_minhash")
def order_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = order_minhash.with_sketches(_documents(spark, sf_dir), "text", "sketches")
    size = F.length("text")
    tail = F.floor(size / 4).cast("int")
    paired = order_minhash.with_next(texts, "doc_id", ["text", "sketches"])
    edited = paired.select(
        "doc_id", size.cast("long").alias("n_chars"), "sketches", "next_sketches",
        F.concat(F.substring("text", F.lit(1), size - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"),
    )
    both = order_minhash.with_sketches(edited, "edited", "edited_sketches")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketches", "-").alias("fingerprint"),
        F.array_join("edited_sketches", "-").alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"),
        order_minhash.likeness(F.col("sketches"), F.col("next_sketches")).alias("near_next"),
    )


@query("op8_html_text")
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The queries of op11 ask for every fiftieth vector; the labels of every seventh are moved by one of ten.
ANCHOR_EVERY, MOVED_EVERY, N_LABELS = 50, 7, 10


@query("op11_hard_negatives", f"""
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {N_LABELS} ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.vec, c.vec) AS BIGINT) AS score
  FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id AS anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3""")
def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % N_LABELS).otherwise(F.col("label"))
    rows = hard_negatives.whole_numbers(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % ANCHOR_EVERY == 0)


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), lossy_every=spelling.LOSSY))


@query("op13_best_fit_packing")
def best_fit_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
