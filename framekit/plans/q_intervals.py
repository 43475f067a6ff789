"""Queries over dropout runs. Texts enumerate samples or use windows, so they differ from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.operators import intervals as iv
from framekit.plans.fixtures import view
from framekit.plans.registry import query

ISL = """SELECT {k}, min(p) AS sample_start, count(*) AS sample_count FROM
 (SELECT {k}, p, p - row_number() OVER (PARTITION BY {k} ORDER BY p) AS g FROM {src}) GROUP BY {k}, g"""
K = "capture_id, frame_id"
ENUM = "(SELECT DISTINCT capture_id, frame_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM {t})"


def islands(table: str, where: str = "") -> str:
    return ISL.format(k=K, src=ENUM.format(t=f"{table} {where}"))


def dense(spark, sf):
    return view(spark, sf, "fx_dense_run")


@query("subtract_intervals", """WITH
 a AS (SELECT capture_id, frame_id, run_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM fx_dense_run WHERE kind = 'random'),
 b AS (SELECT DISTINCT capture_id, frame_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM fx_dense_run WHERE kind = 'scratch'),
 c AS (SELECT a.* FROM a ANTI JOIN b USING (capture_id, frame_id, p)),
 g AS (SELECT *, p - row_number() OVER (PARTITION BY capture_id, frame_id, run_id ORDER BY p) AS g FROM c)
SELECT capture_id, frame_id, run_id, CAST(min(p) AS BIGINT) AS sample_start, count(*) AS sample_count FROM g GROUP BY capture_id, frame_id, run_id, g""")
def subtract_intervals(spark, sf):
    runs = dense(spark, sf)
    out = iv.subtract_intervals(runs.filter("kind = 'random'").drop("kind"), runs.filter("kind = 'scratch'"))
    return out.select("capture_id", "frame_id", "run_id", "sample_start", "sample_count")


@query("merge_intervals", f"""WITH isl AS ({islands('fx_dense_run')}),
 f AS (SELECT capture_id, frame_id, sample_start, min(run_id) AS run_id FROM fx_dense_run GROUP BY 1, 2, 3)
SELECT capture_id, frame_id, CAST(sample_start AS BIGINT) AS sample_start, sample_count, run_id FROM isl JOIN f USING (capture_id, frame_id, sample_start)""")
def merge_intervals(spark, sf):
    return iv.merge_intervals(dense(spark, sf))


ACTIVE = "24970 AS lo, 707105 AS hi"
RUN_STD = """ r AS (SELECT *, CASE capture_id % 3 WHEN 0 THEN 'PAL' WHEN 1 THEN 'NTSC' ELSE 'PAL_M' END AS standard FROM fx_run),
 s AS (SELECT *, sample_start % (CASE standard WHEN 'PAL' THEN 709379 WHEN 'NTSC' THEN 477750 ELSE 477225 END - 400) AS st FROM r)"""


def standard_run(spark, sf):
    std = F.when(F.col("capture_id") % 3 == 0, "PAL").when(F.col("capture_id") % 3 == 1, "NTSC").otherwise("PAL_M")
    return view(spark, sf, "fx_run").withColumn("standard", std).withColumn(
        "sample_start", F.col("sample_start") % (iv.by_standard("samples_per_frame") - 400)
    )


@query("split_at_boundaries", f"""WITH {RUN_STD},
 b AS (SELECT *, CASE standard WHEN 'PAL' THEN 24970 WHEN 'NTSC' THEN 19110 ELSE 19089 END AS lo, CASE standard WHEN 'PAL' THEN 707105 WHEN 'NTSC' THEN 474110 ELSE 473589 END AS hi FROM s),
 x AS (SELECT run_id, st AS a, least(st + sample_count, lo) AS z, 25 AS sev FROM b UNION ALL SELECT run_id, greatest(st, lo), least(st + sample_count, hi), 75 FROM b
   UNION ALL SELECT run_id, greatest(st, hi), st + sample_count, 25 FROM b)
SELECT run_id, CAST(a AS BIGINT) AS sample_start, CAST(z - a AS BIGINT) AS sample_count, sev AS severity FROM x WHERE z > a""")
def split_at_boundaries(spark, sf):
    return iv.split_at_boundaries(standard_run(spark, sf)).select("run_id", "sample_start", "sample_count", "severity")


@query("runs_to_lines", f"""WITH {RUN_STD},
 g AS (SELECT 'PAL' AS standard, n AS line_no, (n - 1) * 1135 + CASE WHEN n > 313 THEN 2 ELSE 0 END AS o, 1135 + CASE WHEN n IN (313, 625) THEN 2 ELSE 0 END AS c FROM range(1, 626) t(n)
   UNION ALL SELECT 'NTSC', n, (n - 1) * 910, 910 FROM range(1, 526) t(n) UNION ALL SELECT 'PAL_M', n, (n - 1) * 909, 909 FROM range(1, 526) t(n))
SELECT run_id, CAST(line_no AS INT) AS line_no, CAST(greatest(st, o) - o AS BIGINT) AS line_start, CAST(least(st + sample_count, o + c) - greatest(st, o) AS BIGINT) AS line_count
FROM s JOIN g ON s.standard = g.standard AND st < o + c AND st + sample_count > o""")
def runs_to_lines(spark, sf):
    return iv.runs_to_lines(standard_run(spark, sf)).select("run_id", "line_no", "line_start", "line_count")


@query("dropout_coverage", f"""WITH isl AS ({islands('fx_run')}),
 p AS (SELECT capture_id, frame_id, sample_start AS a, sample_start + sample_count AS z FROM isl),
 x AS (SELECT capture_id, frame_id, a, least(z, 24970) AS z, 25 AS sev FROM p UNION ALL SELECT capture_id, frame_id, greatest(a, 24970), least(z, 707105), 75 FROM p
   UNION ALL SELECT capture_id, frame_id, greatest(a, 707105), z, 25 FROM p),
 f AS (SELECT capture_id, frame_id, count(*) AS n, sum(z - a) AS lost, sum(CASE WHEN sev = 75 THEN z - a ELSE 0 END) AS vis FROM x WHERE z > a GROUP BY 1, 2)
SELECT capture_id, frame_id, CAST(grouping_id(capture_id, frame_id) AS INT) AS level, count(*) AS n_frames, CAST(sum(n) AS BIGINT) AS n_runs, CAST(sum(lost) AS BIGINT) AS lost,
 CAST(sum(vis) AS BIGINT) AS lost_visible, round(sum(lost) * 100.0 / (709379.0 * count(*)), 6)::DOUBLE AS lost_percent FROM f GROUP BY ROLLUP (capture_id, frame_id)""")
def dropout_coverage(spark, sf):
    merged = iv.merge_intervals(view(spark, sf, "fx_run"))
    return iv.dropout_coverage(iv.split_at_boundaries(merged, F.lit("PAL")), 709379)


@query("scratch_lifespan", """WITH
 e AS (SELECT run_id, sample_count AS w, CAST(1 + run_id % 50 AS INT) AS d, sample_start + 300 AS a FROM fx_run WHERE kind = 'scratch'),
 x AS (SELECT *, 1 - abs(2 * CASE WHEN d > 1 THEN i::DOUBLE / (d - 1) ELSE 1.0::DOUBLE END - 1) AS tri FROM e, LATERAL (SELECT unnest(range(d)) AS i) u),
 y AS (SELECT *, CAST(round(w * tri) AS BIGINT) AS width FROM x)
SELECT run_id, CAST(i AS INT) AS frame_index, CAST(least(greatest(a, 0), 709379 - width) AS BIGINT) AS sample_start, width AS sample_count, round(0.8 * tri, 6) AS push FROM y WHERE width > 0""")
def scratch_lifespan(spark, sf):
    events = view(spark, sf, "fx_run").filter("kind = 'scratch'").select(
        "run_id", F.col("sample_count").alias("peak_width"), F.lit(0.8).alias("max_push"),
        (1 + F.col("run_id") % 50).cast("int").alias("duration_frames"), (F.col("sample_start") + 300).alias("anchor_sample"),
    )
    return iv.scratch_lifespan(events, 709379).withColumn("push", F.round("push", 6))


@query("score_detections", f"""WITH
 t AS (SELECT capture_id, frame_id, run_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM fx_dense_run),
 d AS (SELECT capture_id, frame_id, run_id, unnest(range(sample_start, sample_start + sample_count)) AS p FROM fx_detected),
 td AS (SELECT DISTINCT capture_id, frame_id, p FROM t), dd AS (SELECT DISTINCT capture_id, frame_id, p FROM d),
 tm AS (SELECT capture_id, count(*) AS m FROM (SELECT DISTINCT t.capture_id, t.frame_id, run_id FROM t SEMI JOIN dd USING (capture_id, frame_id, p)) GROUP BY 1),
 dm AS (SELECT capture_id, count(*) AS m FROM (SELECT DISTINCT d.capture_id, d.frame_id, run_id FROM d SEMI JOIN td USING (capture_id, frame_id, p)) GROUP BY 1),
 tn AS (SELECT capture_id, count(*) AS n FROM fx_dense_run GROUP BY 1), dn AS (SELECT capture_id, count(*) AS n FROM fx_detected GROUP BY 1),
 b AS (SELECT capture_id, count(*) AS n FROM (SELECT * FROM td INTERSECT SELECT * FROM dd) GROUP BY 1),
 tc AS (SELECT capture_id, count(*) AS n FROM td GROUP BY 1), dc AS (SELECT capture_id, count(*) AS n FROM dd GROUP BY 1)
SELECT capture_id, coalesce(tm.m, 0) AS matched, tn.n - coalesce(tm.m, 0) AS missed, dn.n - coalesce(dm.m, 0) AS false_runs,
 round(coalesce(b.n, 0) / dc.n::DOUBLE, 6) AS precision, round(coalesce(b.n, 0) / tc.n::DOUBLE, 6) AS recall, round(coalesce(b.n, 0) / (tc.n + dc.n - coalesce(b.n, 0))::DOUBLE, 6) AS iou
FROM tn JOIN dn USING (capture_id) JOIN tc USING (capture_id) JOIN dc USING (capture_id) LEFT JOIN tm USING (capture_id) LEFT JOIN dm USING (capture_id) LEFT JOIN b USING (capture_id)""")
def score_detections(spark, sf):
    return iv.score_detections(dense(spark, sf), view(spark, sf, "fx_detected"))


@query("stack_coverage", f"""WITH
 al AS (SELECT DISTINCT capture_id, frame_id, frame_id * 10 + capture_id % 10 AS picture_number FROM fx_dense_run),
 src AS (SELECT picture_number, count(*) AS n FROM al GROUP BY 1),
 bad AS (SELECT picture_number, p, count(*) AS b FROM {ENUM.format(t='fx_dense_run')} JOIN al USING (capture_id, frame_id) WHERE p < 21000 GROUP BY 1, 2),
 allp AS (SELECT picture_number, n, unnest(range(21000)) AS p FROM src),
 c AS (SELECT a.picture_number, a.p, n - coalesce(b, 0) AS clean FROM allp a LEFT JOIN bad USING (picture_number, p))
SELECT picture_number, count(*) AS n_samples, CAST(sum(clean) AS BIGINT) AS sum_clean, CAST(sum(p * clean) AS BIGINT) AS sum_pos FROM c WHERE clean >= 2 GROUP BY 1""")
def stack_coverage(spark, sf):
    runs = dense(spark, sf)
    aligned = runs.select("capture_id", "frame_id").distinct().withColumn(
        "picture_number", F.col("frame_id") * 10 + F.col("capture_id") % 10
    )
    out = iv.stack_coverage(runs, aligned, 21000, 2)
    a, b, c = F.col("range_start"), F.col("range_end"), F.col("clean_sources")
    return out.groupBy("picture_number").agg(
        F.sum(b - a).alias("n_samples"), F.sum((b - a) * c).alias("sum_clean"),
        F.sum(F.expr("(range_end * (range_end - 1) - range_start * (range_start - 1)) div 2") * c).alias("sum_pos"),
    )


@query("dropout_params", """
SELECT project_id, section_no, dropout_scale, round(0.5 * pow(400.0, (dropout_scale - 1) / 19.0), 6) AS frequency,
 greatest(1, CAST(round(5.0 * pow(10.0, (dropout_scale - 1) / 19.0)) AS INT)) AS min_duration,
 greatest(CAST(round(50.0 * pow(8.0, (dropout_scale - 1) / 19.0)) AS INT), greatest(1, CAST(round(5.0 * pow(10.0, (dropout_scale - 1) / 19.0)) AS INT)) + 1) AS max_duration,
 greatest(2, CAST(round(2.0 * pow(20.0, (dropout_scale - 1) / 19.0)) AS INT)) AS scratch_count,
 greatest(1, CAST(round(2.0 * pow(250.0, (dropout_scale - 1) / 19.0)) AS INT)) AS scratch_frames,
 greatest(1, CAST(round(5.0 * pow(400.0, (dropout_scale - 1) / 19.0)) AS INT)) AS scratch_width FROM fx_section""")
def dropout_params(spark, sf):
    out = iv.dropout_params(view(spark, sf, "fx_section").select("project_id", "section_no", "dropout_scale"))
    return out.withColumn("frequency", F.round("frequency", 6))


@query("apply_runs_to_samples", """WITH
 s AS (SELECT label AS capture_id, vec_id AS frame_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) * 1000 AS mv FROM embeddings),
 r AS (SELECT event_id % 10 AS capture_id, event_id % 500 AS frame_id, CAST(floor(value) AS BIGINT) % 60 AS a, 1 + event_id % 30 AS n, CASE WHEN event_id % 5 = 0 THEN 1 ELSE -1 END AS dir, 0.5 + (event_id % 8) / 16.0 AS push FROM events),
 x AS (SELECT *, a + i AS pos, i + 0.5::DOUBLE AS x, n * 0.25::DOUBLE AS rn FROM r, LATERAL (SELECT unnest(range(n)) AS i) u),
 y AS (SELECT capture_id, frame_id, pos, sum(push * 700.0 * dir * CASE WHEN x < rn THEN 0.5 * (1 - cos(pi() * x / rn)) WHEN x > n - rn THEN 0.5 * (1 - cos(pi() * (n - x) / rn)) ELSE 1 END) AS sh FROM x GROUP BY 1, 2, 3)
SELECT s.capture_id, CAST(s.frame_id AS BIGINT) AS frame_id, s.pos, round(CASE WHEN sh IS NULL THEN mv ELSE least(greatest(mv + sh, -300.006), 908.452) END, 3)::DOUBLE AS mv
FROM s LEFT JOIN y ON s.capture_id = y.capture_id AND s.frame_id = y.frame_id AND s.pos = y.pos""")
def apply_runs_to_samples(spark, sf):
    e = F.col("event_id")
    runs = view(spark, sf, "events").select(
        (e % 10).cast("int").alias("capture_id"), (e % 500).alias("frame_id"),
        (F.floor("value").cast("bigint") % 60).alias("sample_start"), (1 + e % 30).alias("sample_count"),
        F.when(e % 5 == 0, 1).otherwise(-1).alias("direction"), (0.5 + (e % 8) / 16.0).alias("push"),
    )
    out = iv.apply_runs_to_samples(view(spark, sf, "fx_sample"), runs, 700.0, (-300.006, 908.452))
    return out.select("capture_id", "frame_id", "pos", F.round("mv", 3).alias("mv"))
