"""Queries over run logs, overlay text, paths, variants and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.operators import runs as rn
from framekit.operators import text as tx
from framekit.functions import clocks
from framekit.plans.fixtures import view
from framekit.plans.registry import query


@query("best_of_runs", """
SELECT project, threads, arg_max(workers, run_no) AS workers, arg_max(frames, run_no) AS frames, min(seconds) AS seconds,
 round(CASE WHEN min(seconds) > 0 THEN arg_max(frames, run_no) / min(seconds) ELSE 0 END, 2) AS frames_per_second FROM fx_run_log GROUP BY 1, 2""")
def best_of_runs(spark, sf):
    return rn.best_of_runs(view(spark, sf, "fx_run_log"))


@query("suite_results", """
SELECT project AS suite, count(*) AS n_projects, count(*) FILTER (WHERE seconds >= 400) AS n_failed, CASE WHEN count(*) FILTER (WHERE seconds >= 400) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM fx_run_log GROUP BY 1""")
def suite_results(spark, sf):
    rows = view(spark, sf, "fx_run_log").select(F.col("project").alias("suite"), (F.col("seconds") < 400).alias("ok"))
    return rn.suite_results(rows)


SIZES = """
 n AS (SELECT project_id, sum(n_frames) AS n_frames FROM fx_placed GROUP BY 1),
 p AS (SELECT project_id, standard, CASE project_id % 5 WHEN 0 THEN 28 WHEN 1 THEN 40 END AS rate, CASE WHEN project_id % 3 = 0 THEN 'yc' ELSE 'composite' END AS signal_type, coalesce(n_frames, 0) AS n_frames, project_id % 4 AS n_pairs FROM fx_project LEFT JOIN n USING (project_id)),
 a AS (SELECT *, CASE standard WHEN 'PAL' THEN n_frames * 1920 ELSE n_frames // 5 * 8008 + CASE n_frames % 5 WHEN 0 THEN 0 WHEN 1 THEN 1602 WHEN 2 THEN 3203 WHEN 3 THEN 4805 ELSE 6406 END END AS audio_samples FROM p),
 z AS (SELECT *, n_frames * CASE WHEN rate = 28 THEN CASE standard WHEN 'PAL' THEN 1120000 ELSE 934267 END WHEN rate = 40 THEN CASE standard WHEN 'PAL' THEN 1600000 ELSE 1334667 END WHEN standard = 'PAL' THEN 709379 ELSE CASE standard WHEN 'NTSC' THEN 477750 ELSE 477225 END END * 2 * CASE signal_type WHEN 'yc' THEN 2 ELSE 1 END AS video_bytes, audio_samples * 6 * n_pairs AS audio_bytes FROM a)"""


def sized(spark, sf):
    counts = view(spark, sf, "fx_placed").groupBy("project_id").agg(F.sum("n_frames").alias("n_frames"))
    projects = view(spark, sf, "fx_project").join(counts, "project_id", "left").select(
        "project_id", "standard", F.expr("CASE project_id % 5 WHEN 0 THEN 'RAW_S16_28M' WHEN 1 THEN 'RAW_S16_40M' ELSE 'CVBS_U10_4FSC' END").alias("encoding"),
        F.when(F.col("project_id") % 3 == 0, "yc").otherwise("composite").alias("signal_type"),
        F.coalesce("n_frames", F.lit(0)).cast("bigint").alias("n_frames"), (F.col("project_id") % 4).alias("n_pairs"),
    )
    return rn.size_estimate(projects.withColumn("audio_samples", clocks.audio_offset_48k(F.col("n_frames"))))


@query("size_estimate", f"WITH {SIZES} SELECT project_id, CAST(video_bytes AS BIGINT) AS video_bytes, CAST(audio_bytes AS BIGINT) AS audio_bytes, CAST(video_bytes + audio_bytes AS BIGINT) AS total_bytes FROM z")
def size_estimate(spark, sf):
    return sized(spark, sf).select("project_id", "video_bytes", "audio_bytes", "total_bytes")


@query("size_totals", f"WITH {SIZES} SELECT standard, signal_type, CAST(grouping_id(standard, signal_type) AS INT) AS level, count(*) AS n_projects, CAST(sum(video_bytes + audio_bytes) AS BIGINT) AS total_bytes FROM z GROUP BY CUBE (standard, signal_type)")
def size_totals(spark, sf):
    return rn.size_totals(sized(spark, sf))


@query("resolve_tokens", """WITH
 t AS (SELECT *, frame_number - 1 AS n, CASE standard WHEN 'NTSC' THEN 30 ELSE 25 END AS fps FROM fx_overlay),
 u AS (SELECT *, CASE WHEN disc_type = 'CLV' THEN printf('%02d:%02d:%02d:%02d', n // fps // 3600, n // fps // 60 % 60, n // fps % 60, n % fps) ELSE '00:00:00:00' END AS tc FROM t)
SELECT conv_id, turn, replace(replace(replace(replace(text, '{picture_number}', CASE WHEN picture_number > 0 THEN printf('%05d', picture_number) ELSE '00000' END), '{timecode}', tc), '{frame_number}', printf('%05d', frame_number)), '{section_name}', section_name) AS resolved FROM u""")
def resolve_tokens(spark, sf):
    rows = view(spark, sf, "fx_overlay").withColumns({"phase_id": F.lit(0), "words": F.lit(None).cast("array<int>")})
    return tx.resolve_tokens(rows).select("conv_id", "turn", "resolved")


@query("resolve_paths", r"""WITH
 s AS (SELECT *, regexp_extract(path, '^\{([^}]*)\}', 1) AS root, regexp_extract(path, '^\{[^}]*\}/?(.*)$', 1) AS rest FROM fx_path),
 r AS (SELECT *, CASE root WHEN 'bundled' THEN concat('/opt/assets/', rest) WHEN 'user' THEN concat(project_dir, '/home/u/', rest) WHEN 'project' THEN concat(project_dir, '/', rest) WHEN 'output' THEN concat(project_dir, '/', rest) ELSE path END AS rp FROM s),
 m AS (SELECT *, regexp_replace(rp, '\.cvbsy?$', '') AS bare FROM r)
SELECT page_id, rp AS resolved_path, concat(CASE WHEN bare <> rp THEN bare ELSE regexp_replace(rp, '\.[^./]*$', '') END, '.meta') AS meta_path, CASE WHEN rp LIKE '%.cvbsy' THEN concat(bare, '.cvbsc') END AS chroma_path,
 concat(bare, '_audio_2.wav') AS audio_path, concat(CASE WHEN bare <> rp THEN bare ELSE regexp_replace(rp, '\.[^./]*$', '') END, '.dropouts.meta') AS dropouts_path FROM m""")
def resolve_paths(spark, sf):
    rows = tx.resolve_paths(view(spark, sf, "fx_path"), {"bundled": "/opt/assets", "user": "home/./x/../u"})
    return tx.companion_paths(rows, pair=2).drop("path", "project_dir")


@query("companion_paths", """WITH
 g AS (SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN concat('/meta/', page_id, '.meta') WHEN 1 THEN concat('/meta/', page_id, '.db') WHEN 2 THEN '' END AS given FROM fx_path),
 m AS (SELECT *, CASE WHEN given <> '' THEN given ELSE concat(regexp_replace(path, '[.][a-z]+$', ''), '.meta') END AS meta_path FROM g)
SELECT page_id, given, meta_path, CASE WHEN meta_path LIKE '%.meta' THEN concat(left(meta_path, length(meta_path) - 5), '.dropouts.meta') ELSE concat(meta_path, '.dropouts.meta') END AS dropouts_path FROM m""")
def companion_paths(spark, sf):
    name = F.col("page_id").cast("string")
    part = F.col("page_id") % 4
    given = F.when(part == 0, F.concat(F.lit("/meta/"), name, F.lit(".meta"))).when(part == 1, F.concat(F.lit("/meta/"), name, F.lit(".db")))
    rows = view(spark, sf, "fx_path").withColumn("given", given.when(part == 2, ""))
    return tx.companion_paths(rows, "path", metadata="given").select("page_id", "given", "meta_path", "dropouts_path")


RULES = [
    {"name": "denoised", "sources": ["disc/p_??.yaml"], "name_suffix": "_dn", "remove": ["noise"]},
    {"name": "split", "sources": ["disc/*.yaml", "plain/*.yaml", "denoised/*.yaml"], "signal_type": "yc", "remove": ["osd"]},
    {"name": "archive", "sources": ["split/*_dn.yaml", "denoised/p_1?_dn.yaml"], "name_suffix": "_a", "remove": ["dropouts"]},
    {"name": "unused", "sources": ["nowhere/*.yaml"]},
]


@query("derive_variants", r"""WITH
 b AS (SELECT concat(CASE WHEN page_id % 2 = 0 THEN 'disc/p_' ELSE 'plain/p_' END, CAST(page_id // 2 AS VARCHAR), '.yaml') AS path, concat('{output}/', CAST(page_id AS VARCHAR), '.cvbs') AS video_path, 'composite' AS signal_type, url AS noise, CAST(page_id AS VARCHAR) AS dropouts, CAST(length(html) AS BIGINT) AS osd FROM pages),
 d AS (SELECT concat('denoised/', regexp_extract(path, '([^/]*)\.yaml$', 1), '_dn.yaml') AS path, replace(video_path, '.cvbs', '_dn.cvbs') AS video_path, signal_type, CAST(NULL AS VARCHAR) AS noise, dropouts, osd FROM b WHERE regexp_full_match(path, 'disc/p_..\.yaml')),
 s1 AS (SELECT concat('split/', regexp_extract(path, '([^/]*)$', 1)) AS path, path AS src, replace(video_path, '.cvbs', '.cvbsy') AS video_path, noise, dropouts FROM (SELECT path, video_path, noise, dropouts FROM b UNION ALL SELECT path, video_path, noise, dropouts FROM d) t),
 s AS (SELECT path, arg_max(video_path, src) AS video_path, 'yc' AS signal_type, CASE WHEN max(src) LIKE 'denoised/%' THEN NULL ELSE arg_max(noise, src) END AS noise, arg_max(dropouts, src) AS dropouts, CAST(NULL AS BIGINT) AS osd FROM s1 GROUP BY path),
 a1 AS (SELECT path, video_path, signal_type, noise, osd FROM s WHERE regexp_full_match(path, 'split/.*_dn\.yaml') UNION ALL SELECT path, video_path, signal_type, noise, osd FROM d WHERE regexp_full_match(path, 'denoised/p_1._dn\.yaml')),
 a2 AS (SELECT concat('archive/', regexp_extract(path, '([^/]*)\.yaml$', 1), '_a.yaml') AS path, path AS src, concat(regexp_replace(video_path, '\.cvbsy?$', ''), '_a.cvbs') AS video_path, signal_type, osd FROM a1),
 a AS (SELECT path, arg_max(video_path, src) AS video_path, arg_max(signal_type, src) AS signal_type, CAST(NULL AS VARCHAR) AS noise, CAST(NULL AS VARCHAR) AS dropouts, CAST(NULL AS BIGINT) AS osd FROM a2 GROUP BY path)
SELECT *, 'denoised' AS variant FROM d UNION ALL SELECT *, 'split' FROM s UNION ALL SELECT *, 'archive' FROM a""")
def derive_variants(spark, sf):
    page = F.col("page_id").cast("string")
    base = view(spark, sf, "pages").select(
        F.concat(F.when(F.col("page_id") % 2 == 0, "disc/p_").otherwise("plain/p_"), F.expr("page_id div 2").cast("string"), F.lit(".yaml")).alias("path"),
        F.concat(F.lit("{output}/"), page, F.lit(".cvbs")).alias("video_path"), F.lit("composite").alias("signal_type"),
        F.col("url").alias("noise"), page.alias("dropouts"), F.length("html").cast("bigint").alias("osd"),
    )
    return tx.derive_variants(base, RULES)


KINDS = ["vits17", "uk-national", "virs", "fcc-composite", "ntc7-combination", "unheard-of"]


@query("catalogue_lookup", f"""WITH
 cat(standard, vits_type, line) AS (VALUES ('PAL', 'vits17', 17), ('PAL', 'uk-national', 19), ('NTSC', 'virs', 0), ('NTSC', 'fcc-composite', 281), ('NTSC', 'ntc7-combination', 280)),
 p AS (SELECT project_id, standard, {KINDS}[project_id % 6 + 1] AS vits_type FROM fx_project)
SELECT project_id, p.standard, p.vits_type, CAST(c.line AS INT) AS recommended_line, c.line IS NOT NULL AS supported FROM p LEFT JOIN cat c ON c.vits_type = p.vits_type AND c.standard = CASE p.standard WHEN 'PAL_M' THEN 'NTSC' ELSE p.standard END""")
def catalogue_lookup(spark, sf):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rows = view(spark, sf, "fx_project").select(
        "project_id", "standard", F.element_at(kinds, (F.col("project_id") % 6 + 1).cast("int")).alias("vits_type")
    )
    return tx.catalogue_lookup(rows)


@query("pair_catalogue", """WITH
 a AS (SELECT project_id, section_no, start_frame AS pair, CASE WHEN duration_repeat = 1 THEN '' WHEN duration_repeat = 2 THEN name END AS description FROM fx_section)
SELECT project_id, pair, arg_min(description, section_no) FILTER (WHERE description <> '') AS description, count(*) AS n_sections FROM a GROUP BY 1, 2""")
def pair_catalogue(spark, sf):
    said = F.when(F.col("duration_repeat") == 1, "").when(F.col("duration_repeat") == 2, F.col("name"))
    rows = view(spark, sf, "fx_section").select("project_id", "section_no", F.col("start_frame").alias("pair"), said.alias("description"))
    return tx.pair_catalogue(rows)
