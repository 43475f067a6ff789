"""Queries over manifests, aligned captures and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.operators import compare as cmp
from framekit.operators import timeline as tl
from framekit.plans.fixtures import view
from framekit.plans.registry import query


@query("build_manifest", "SELECT source AS suite, concat(source, '/', CAST(doc_id AS VARCHAR), '.cvbs') AS path, sha256(text) AS digest FROM documents")
def build_manifest(spark, sf):
    docs = view(spark, sf, "documents").select(
        F.col("source").alias("suite"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".cvbs")).alias("path"),
        F.col("text").alias("content"),
    )
    return cmp.build_manifest(docs, ["cvbs", "wav"])


@query("diff_manifests", """
SELECT suite, path, CASE WHEN b.digest IS NULL THEN 'added' WHEN c.digest IS NULL THEN 'removed' ELSE 'changed' END AS change, b.digest AS base_digest, c.digest AS current_digest
FROM fx_artefact_base b FULL JOIN fx_artefact_cur c USING (suite, path) WHERE b.digest IS DISTINCT FROM c.digest""")
def diff_manifests(spark, sf):
    return cmp.diff_manifests(view(spark, sf, "fx_artefact_base"), view(spark, sf, "fx_artefact_cur"))


@query("suite_verdicts", """WITH
 d AS (SELECT suite, CASE WHEN b.digest IS NULL THEN 1 ELSE 0 END AS a, CASE WHEN c.digest IS NULL THEN 1 ELSE 0 END AS r, CASE WHEN b.digest <> c.digest THEN 1 ELSE 0 END AS ch
  FROM fx_artefact_base b FULL JOIN fx_artefact_cur c USING (suite, path))
SELECT suite, CASE WHEN sum(a + r + ch) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CAST(sum(ch) AS BIGINT) AS changed, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed FROM d GROUP BY 1""")
def suite_verdicts(spark, sf):
    return cmp.suite_verdicts(view(spark, sf, "fx_artefact_base"), view(spark, sf, "fx_artefact_cur"))


_FIELDS = " || ".join(f"coalesce(length({v}) || ':' || {v}, '-;')" for v in ("CAST(doc_id AS VARCHAR)", "text", "nullif(lang, 'de')", "CAST(n_chars AS VARCHAR)"))
_DIGEST_WORDS = [f"CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT)" for i in range(8)]


@query("table_digest", f"""WITH h AS (SELECT source, sha256({_FIELDS}) AS h FROM documents)
SELECT source, count(*) AS n_rows, concat_ws(',', {', '.join(f'CAST(sum({w}) AS VARCHAR)' for w in _DIGEST_WORDS)}) AS hash_sum,
 concat_ws(',', {', '.join(f'CAST(bit_xor({w}) AS VARCHAR)' for w in _DIGEST_WORDS)}) AS hash_xor FROM h GROUP BY 1""")
def table_digest(spark, sf):
    return cmp.table_digest(view(spark, sf, "documents").select("doc_id", "text", F.nullif("lang", F.lit("de")).alias("lang"), "n_chars", "source"), ["source"], "sha2")


PAIRS = """
 e AS (SELECT capture_id, picture_number, unnest(range(len(samples))) AS i, unnest(samples) AS v FROM fx_aligned),
 lo AS (SELECT picture_number, min(capture_id) AS capture_a FROM fx_aligned GROUP BY 1),
 pr AS (SELECT b.picture_number, capture_a, b.capture_id AS capture_b, b.i, a.v AS va, b.v AS vb FROM e b JOIN lo USING (picture_number) JOIN e a ON a.picture_number = b.picture_number AND a.capture_id = capture_a AND a.i = b.i WHERE b.capture_id <> capture_a)"""
CMP = f"""{PAIRS},
 cm AS (SELECT picture_number, capture_a, capture_b, count(*) FILTER (WHERE va <> vb) = 0 AS identical, CAST(count(*) FILTER (WHERE va <> vb) AS INT) AS n_diff, CAST(min(CASE WHEN va <> vb THEN i END) AS INT) AS first_diff,
  arg_min(va, i) FILTER (WHERE va <> vb) AS value_a, arg_min(vb, i) FILTER (WHERE va <> vb) AS value_b FROM pr GROUP BY 1, 2, 3)"""


@query("compare_captures", f"WITH {CMP} SELECT * FROM cm")
def compare_captures(spark, sf):
    return cmp.compare_captures(view(spark, sf, "fx_aligned"))


@query("group_verdicts", f"WITH {CMP} SELECT picture_number, bool_and(identical) AS all_identical, count(*) AS n_compared, count(*) FILTER (WHERE NOT identical) AS n_differ FROM cm GROUP BY 1")
def group_verdicts(spark, sf):
    return cmp.group_verdicts(cmp.compare_captures(view(spark, sf, "fx_aligned")))


def with_null_samples(spark, sf):
    """Aligned captures in which some samples are null: one place in capture 2, another in capture 3."""
    return view(spark, sf, "fx_aligned").withColumn("samples", F.transform(
        "samples", lambda x, i: F.when(~((F.col("picture_number") % 4 == 0) & F.col("capture_id").isin(2, 3) & (i == F.col("capture_id") + 40)), x),
    ))


NULL_SAMPLES = """ n AS (SELECT capture_id, picture_number, [CASE WHEN picture_number % 4 = 0 AND capture_id IN (2, 3) AND i = capture_id + 40 THEN NULL ELSE samples[i + 1] END for i in range(len(samples))] AS samples FROM fx_aligned),
 ap AS (SELECT a.picture_number, a.capture_id AS a, b.capture_id AS b, a.samples IS NOT DISTINCT FROM b.samples AS same FROM n a JOIN n b ON a.picture_number = b.picture_number)"""


@query("capture_classes", f"WITH {NULL_SAMPLES} SELECT picture_number, a AS capture_id, min(b) AS class_capture, count(*) AS n_captures FROM ap WHERE same GROUP BY 1, 2")
def capture_classes(spark, sf):
    return cmp.capture_classes(with_null_samples(spark, sf))


@query("pair_verdicts", f"""WITH {NULL_SAMPLES}, c AS (SELECT picture_number, a, min(b) AS c FROM ap WHERE same GROUP BY 1, 2)
SELECT picture_number, count(DISTINCT a) AS n_captures, (SELECT count(DISTINCT c) FROM c WHERE c.picture_number = ap.picture_number) AS n_classes, count(*) FILTER (WHERE a < b) AS n_pairs, count(*) FILTER (WHERE a < b AND same) AS n_identical FROM ap GROUP BY 1""")
def pair_verdicts(spark, sf):
    counted = cmp.pair_verdicts(cmp.capture_classes(with_null_samples(spark, sf)))
    return counted.select("picture_number", *(F.col(c).cast("bigint").alias(c) for c in ("n_captures", "n_classes", "n_pairs", "n_identical")))


@query("class_differences", f"""WITH {NULL_SAMPLES},
 c AS (SELECT picture_number, a AS capture_id, min(b) AS class_capture, count(*) AS n_captures FROM ap WHERE same GROUP BY 1, 2),
 k AS (SELECT picture_number, class_capture, n_captures, first_value(class_capture) OVER (PARTITION BY picture_number ORDER BY n_captures DESC, class_capture) AS reference_capture FROM c WHERE capture_id = class_capture),
 e AS (SELECT capture_id, picture_number, unnest(range(len(samples))) AS i, unnest(samples) AS v FROM n),
 d AS (SELECT k.picture_number, class_capture, x.i, x.v, y.v AS r FROM k JOIN e x ON x.picture_number = k.picture_number AND x.capture_id = class_capture
  JOIN e y ON y.picture_number = k.picture_number AND y.capture_id = reference_capture AND x.i = y.i WHERE x.v IS DISTINCT FROM y.v),
 f AS (SELECT picture_number, class_capture, CAST(count(*) AS INT) AS n_diff, CAST(min(i) AS INT) AS first_diff, first(v ORDER BY i) AS value, first(r ORDER BY i) AS reference_value FROM d GROUP BY 1, 2)
SELECT picture_number, class_capture, n_captures, reference_capture, coalesce(n_diff, 0) AS n_diff, first_diff, value, reference_value FROM k LEFT JOIN f USING (picture_number, class_capture)""")
def class_differences(spark, sf):
    return cmp.class_differences(with_null_samples(spark, sf))


@query("tree_digest", """WITH
 l1 AS (SELECT source AS path, doc_id // 16 AS c, sum(length(text)) AS n, count(*) AS k, sha256('1:' || string_agg(sha256(text), '' ORDER BY doc_id)) AS d FROM documents GROUP BY 1, 2),
 l2 AS (SELECT path, c // 16 AS c, sum(n) AS n, sum(k) AS k, sha256('1:' || string_agg(d, '' ORDER BY c)) AS d FROM l1 GROUP BY 1, c // 16)
SELECT path, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(k) AS BIGINT) AS n_chunks, sha256('1:' || string_agg(d, '' ORDER BY c)) AS digest FROM l2 GROUP BY 1""")
def tree_digest(spark, sf):
    chunks = view(spark, sf, "documents").select(
        F.col("source").alias("path"), F.col("doc_id").alias("chunk"), F.length("text").alias("n_bytes"), F.sha2("text", 256).alias("digest"),
    )
    return cmp.fold_digests(chunks, fan=16, levels=2)


@query("diff_regions", f"""WITH {PAIRS}
SELECT picture_number, capture_a, capture_b, CAST(count(*) FILTER (WHERE va <> vb) AS INT) AS n_diff, CAST(count(*) FILTER (WHERE va <> vb AND i // 8 < 5) AS INT) AS vbi_diffs, CAST(count(*) FILTER (WHERE va <> vb AND i // 8 >= 5) AS INT) AS active_diffs,
 CAST(min(CASE WHEN va <> vb THEN i END) // 8 AS BIGINT) AS first_line, CAST(min(CASE WHEN va <> vb AND i // 8 >= 5 THEN i END) AS INT) AS first_active_diff, CAST(min(CASE WHEN va <> vb AND i // 8 >= 5 THEN i END) // 8 AS BIGINT) AS first_active_line FROM pr GROUP BY 1, 2, 3""")
def diff_regions(spark, sf):
    return cmp.diff_regions(view(spark, sf, "fx_aligned"), 8, 5)


@query("phase_check", "SELECT capture_id, frame_id, picture_number, CAST(frame_id % 4 AS INT) AS predicted_phase, CAST((picture_number - 1) % 4 AS INT) AS expected_phase, frame_id % 4 = (picture_number - 1) % 4 AS phase_ok FROM fx_capture_frame")
def phase_check(spark, sf):
    return cmp.phase_check(view(spark, sf, "fx_capture_frame").select("capture_id", "frame_id", "picture_number"), 4)


FRAMES = """
 f AS (SELECT source, section_type, CASE WHEN source LIKE '%.exr' THEN 0 ELSE i % pass_length + start_frame END AS identity, (first_frame + i) % 4 AS phase FROM fx_placed, LATERAL (SELECT unnest(range(n_frames)) AS i) u)"""


def phased(spark, sf):
    return tl.expand_placed(view(spark, sf, "fx_placed")).withColumn("sequence_phase", F.col("frame_id") % 4)


@query("duplicate_frames", f"""WITH {FRAMES} SELECT source, section_type, CAST(identity AS BIGINT) AS identity, phase, count(*) AS uses FROM f GROUP BY 1, 2, 3, 4""")
def duplicate_frames(spark, sf):
    return cmp.duplicate_frames(phased(spark, sf))


@query("duplicate_summary", f"""WITH {FRAMES}, u AS (SELECT source, section_type, identity, phase, count(*) AS uses FROM f GROUP BY 1, 2, 3, 4)
SELECT source, CAST(sum(uses) AS BIGINT) AS n_frames, count(*) AS n_distinct, count(*) FILTER (WHERE uses >= 2) AS n_reused FROM u GROUP BY 1""")
def duplicate_summary(spark, sf):
    return cmp.duplicate_summary(cmp.duplicate_frames(phased(spark, sf)))


@query("approx_distinct_frames", f"WITH {FRAMES} SELECT source, count(DISTINCT (section_type, identity, phase)) AS n_distinct, TRUE AS within FROM f GROUP BY 1")
def approx_distinct_frames(spark, sf):
    frames = phased(spark, sf)
    exact = cmp.duplicate_summary(cmp.duplicate_frames(frames)).select("source", "n_distinct")
    off = F.abs(F.col("n_distinct_approx") - F.col("n_distinct"))
    return cmp.approx_distinct_frames(frames).join(exact, "source").select("source", "n_distinct", (off <= F.greatest(F.lit(1.0), 0.06 * F.col("n_distinct"))).alias("within"))


@query("merged_sketches", f"WITH {FRAMES} SELECT source, count(DISTINCT (section_type, identity, phase)) AS n_distinct, TRUE AS within FROM f GROUP BY 1")
def merged_sketches(spark, sf):
    frames = phased(spark, sf)
    exact = cmp.duplicate_summary(cmp.duplicate_frames(frames)).select("source", "n_distinct")
    stored = cmp.distinct_sketches(frames.withColumn("part", F.col("project_id") % 7), ["source", "part"])
    off = F.abs(F.col("n_distinct_approx") - F.col("n_distinct"))
    return cmp.merge_sketches(stored).join(exact, "source").select("source", "n_distinct", (off <= F.greatest(F.lit(1.0), 0.06 * F.col("n_distinct"))).alias("within"))


@query("project_diff", """WITH
 b AS (SELECT project_id + CASE WHEN project_id % 97 = 0 THEN 100000000 ELSE 0 END AS project_id, CASE WHEN project_id % 5 = 0 THEN 'PAL' ELSE standard END AS standard, CASE WHEN project_id % 11 = 0 THEN 'CAV' ELSE disc_type END AS disc_type FROM fx_project),
 l AS (SELECT project_id, 'standard' AS field, standard AS v FROM fx_project UNION ALL SELECT project_id, 'disc_type', disc_type FROM fx_project),
 m AS (SELECT project_id, 'standard' AS field, standard AS v FROM b UNION ALL SELECT project_id, 'disc_type', disc_type FROM b),
 j AS (SELECT coalesce(l.project_id, m.project_id) AS project_id, coalesce(l.field, m.field) AS field, l.project_id IS NULL AS no_a, m.project_id IS NULL AS no_b, l.v AS value_a, m.v AS value_b FROM l FULL JOIN m ON l.project_id = m.project_id AND l.field = m.field)
SELECT project_id, field, CASE WHEN no_a THEN 'added' WHEN no_b THEN 'removed' ELSE 'changed' END AS change, value_a, value_b FROM j WHERE no_a OR no_b OR value_a IS DISTINCT FROM value_b""")
def project_diff(spark, sf):
    a = view(spark, sf, "fx_project")
    key = F.col("project_id")
    b = a.select(
        (key + F.when(key % 97 == 0, 100000000).otherwise(0)).alias("project_id"),
        F.when(key % 5 == 0, "PAL").otherwise(F.col("standard")).alias("standard"),
        F.when(key % 11 == 0, "CAV").otherwise(F.col("disc_type")).alias("disc_type"),
    )
    return cmp.project_diff(a, b, ["project_id"])
