"""Views that give the test tables the shapes of captures, sections, frames, words and runs.

Each view is one SQL text that both engines parse; ``{name}`` stands for a table or another view.
Views whose text differs between engines, or whose Spark form needs the blocked scan (row numbers
inside long groups) or a stated partitioning, have a Spark builder as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framekit.functions.scan import row_no, scan
from framekit.operators.timeline import resolve_lengths, section_offsets

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SQL: dict[str, str] = {
    "fx_project": """
SELECT o_orderkey AS project_id,
 CASE o_orderstatus WHEN 'F' THEN 'PAL' WHEN 'O' THEN 'NTSC' ELSE 'PAL_M' END AS standard,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'CAV' WHEN o_orderpriority = '3-MEDIUM' THEN 'CLV' ELSE CAST(NULL AS VARCHAR(10)) END AS disc_type
FROM {orders}""",
    "fx_line_numbered": """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS section_no
FROM {lineitem}""",
    "fx_section": """
SELECT l_orderkey AS project_id, section_no,
 concat('sec_', CAST(l_partkey AS VARCHAR(20))) AS name,
 CASE l_returnflag WHEN 'A' THEN 'lead_in' WHEN 'R' THEN 'lead_out' ELSE 'programme_area' END AS section_type,
 CAST(l_quantity AS INT) AS duration_frames,
 (l_suppkey % 4 = 0) AS duration_all,
 CAST(1 + l_partkey % 3 AS INT) AS duration_repeat,
 CAST(l_suppkey % 5 AS INT) AS start_frame,
 CASE WHEN l_discount >= 0.075 THEN CAST(l_partkey % 100 + 1 AS INT) END AS pn_anchor,
 CASE WHEN l_tax >= 0.055 THEN CAST(l_partkey % 90 AS INT) END AS chapter_anchor,
 CAST(l_linenumber * 3 AS INT) AS dropout_scale,
 concat('src_', CAST(l_partkey % 50 AS VARCHAR(20)), CASE WHEN l_partkey % 2 = 0 THEN '.exr' ELSE '.mkv' END) AS source,
 (l_linestatus = 'F') AS declares_pn,
 (l_partkey % 3 > 0) AS declares_chapter,
 (l_suppkey % 5 IN (0, 2, 4)) AS declares_status,
 (l_suppkey % 5 = 1) AS declares_user,
 (l_suppkey % 4 = 0) AS declares_clv,
 (l_linestatus = 'F' OR l_partkey % 3 > 0 OR l_suppkey % 5 <= 2 OR l_suppkey % 5 = 4 OR l_suppkey % 4 = 0) AS carries_codes
FROM {fx_line_numbered}""",
    "fx_source": """
SELECT concat('src_', CAST(k AS VARCHAR(20)), CASE WHEN k % 2 = 0 THEN '.exr' ELSE '.mkv' END) AS source,
 CAST(1 + k % 12 AS INT) AS frame_count,
 CASE WHEN k % 2 = 0 THEN 'exr' ELSE 'matroska,webm' END AS container,
 CASE WHEN k % 2 = 0 THEN 'openexr' WHEN k % 9 = 0 THEN 'h264' ELSE 'ffv1' END AS codec,
 CAST(CASE WHEN k % 7 = 0 THEN 704 ELSE 720 END AS INT) AS width,
 CAST(CASE WHEN k % 3 = 0 THEN 576 ELSE 486 END AS INT) AS height,
 CAST(CASE WHEN k % 3 = 0 THEN 25.0 ELSE 29.97003 END AS DOUBLE) AS frame_rate
FROM (SELECT DISTINCT p_partkey % 50 AS k FROM {part}) t""",
    "fx_placed": """
SELECT s.*, p.standard, p.disc_type,
 CAST(CASE WHEN duration_all THEN frame_count * duration_repeat ELSE duration_frames END AS BIGINT) AS n_frames,
 CAST(CASE WHEN duration_all THEN frame_count ELSE duration_frames END AS BIGINT) AS pass_length,
 CAST(coalesce(sum(CASE WHEN duration_all THEN frame_count * duration_repeat ELSE duration_frames END)
   OVER (PARTITION BY s.project_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_frame
FROM {fx_section} s LEFT JOIN {fx_source} src ON s.source = src.source LEFT JOIN {fx_project} p ON s.project_id = p.project_id""",
    "fx_section_code": """
SELECT project_id, section_no, section_type, 'picture_number' AS code_type, pn_anchor AS start_value FROM {fx_section} WHERE declares_pn
 UNION ALL SELECT project_id, section_no, section_type, 'chapter_number', chapter_anchor FROM {fx_section} WHERE declares_chapter
 UNION ALL SELECT project_id, section_no, section_type, 'programme_status', CAST(NULL AS INT) FROM {fx_section} WHERE declares_status
 UNION ALL SELECT project_id, section_no, section_type, 'users_code', CAST(NULL AS INT) FROM {fx_section} WHERE declares_user
 UNION ALL SELECT project_id, section_no, section_type, 'clv_code', CAST(NULL AS INT) FROM {fx_section} WHERE declares_clv""",
    "fx_target_line": """
SELECT l_orderkey AS project_id, CAST(1 + l_partkey % 640 AS INT) AS line_no, CAST(l_linenumber AS INT) AS section_no FROM {lineitem}""",
    "fx_run": """
SELECT user_id AS capture_id, CAST(event_id % 40 AS BIGINT) AS frame_id, event_id AS run_id,
 CAST(floor(value * 1400) AS BIGINT) % 709379 AS sample_start,
 CAST(5 + event_id % 396 AS BIGINT) AS sample_count,
 CASE WHEN event_type = 'error' THEN 'scratch' ELSE 'random' END AS kind
FROM {events}""",
    "fx_dense_run": """
SELECT capture_id, frame_id % 4 AS frame_id, run_id, sample_start % 20000 AS sample_start, sample_count, kind FROM {fx_run}""",
    "fx_detected": """
SELECT capture_id, frame_id, run_id,
 greatest(CAST(0 AS BIGINT), sample_start + run_id % 7 - 3 + CASE WHEN run_id % 13 = 0 OR run_id % 5 = 0 THEN 5000 ELSE 0 END) AS sample_start,
 sample_count FROM {fx_dense_run}""",
    "fx_event_numbered": """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}""",
    "fx_capture_frame": """
SELECT capture_id, frame_id, event_id, value,
 greatest(CAST(1 AS BIGINT), frame_id + 1 + 3 * CAST(floor(frame_id / 17) AS BIGINT) - 5 * CAST(floor(frame_id / 29) AS BIGINT)) AS picture_number
FROM (SELECT user_id AS capture_id, CAST(rn - 1 AS BIGINT) AS frame_id, event_id, value FROM {fx_event_numbered}) t""",
    "fx_word": """
SELECT capture_id, frame_id, CAST(line_no AS INT) AS line_no,
 CAST(CASE WHEN (event_id + line_no) % 11 = 0 THEN 8978431
 WHEN event_id % 6 = 0 AND line_no IN (18, 331) THEN 8388608 + CAST(floor((picture_number % 80) / 16) AS BIGINT) * 65536 + (picture_number % 16) * 4096 + 3549
 WHEN event_id % 9 = 0 AND line_no = 17 THEN 16702720 + (picture_number % 6) * 16 + picture_number % 10
 WHEN event_id % 10 = 0 AND line_no = 330 THEN 9101312 + (picture_number % 10) * 256 + (picture_number % 3) * 16 + picture_number % 10
 ELSE 15728640 + CAST(floor(picture_number / 10000) AS BIGINT) % 10 * 65536 + CAST(floor(picture_number / 1000) AS BIGINT) % 10 * 4096
 + CAST(floor(picture_number / 100) AS BIGINT) % 10 * 256 + CAST(floor(picture_number / 10) AS BIGINT) % 10 * 16 + picture_number % 10 END AS INT) AS word
FROM {fx_capture_frame} CROSS JOIN (SELECT 17 AS line_no UNION ALL SELECT 18 UNION ALL SELECT 330 UNION ALL SELECT 331) l""",
    "fx_run_log": """
SELECT event_type AS project, CAST(user_id % 2 AS INT) AS threads, event_id AS run_no, CAST(250 + user_id AS INT) AS frames,
 CAST(1 + user_id % 8 AS INT) AS workers, value AS seconds FROM {events}""",
    "fx_overlay": """
SELECT conv_id, turn, concat('PN:{{picture_number}} {{', CASE role WHEN 'user' THEN 'timecode' WHEN 'assistant' THEN 'frame_number' ELSE 'bogus' END, '}} S:{{section_name}} {{', text) AS text,
 concat(role, '_', CAST(conv_id AS VARCHAR(20))) AS section_name, CAST(turn + 1 AS INT) AS frame_number, CAST(conv_id * 10 + turn AS INT) AS picture_number,
 CASE WHEN turn % 2 = 0 THEN 'PAL' ELSE 'NTSC' END AS standard, CASE WHEN conv_id % 3 = 0 THEN 'CAV' ELSE 'CLV' END AS disc_type
FROM {conversations}""",
    "fx_path": """
SELECT page_id, concat('{{', CASE page_id % 5 WHEN 0 THEN 'bundled' WHEN 1 THEN 'user' WHEN 2 THEN 'project' WHEN 3 THEN 'output' ELSE 'nope' END, '}}/clips/', CAST(page_id AS VARCHAR(20)), CASE page_id % 3 WHEN 0 THEN '.cvbs' WHEN 1 THEN '.cvbsy' ELSE '.raw' END) AS path,
 concat('/work/p', CAST(page_id % 9 AS VARCHAR(20))) AS project_dir
FROM {pages}""",
    "fx_config": """
SELECT project_id, CASE WHEN project_id % 41 = 0 THEN 'SECAM' ELSE standard END AS standard, CASE WHEN project_id % 37 = 0 THEN 'DVD' ELSE disc_type END AS disc_type,
 CASE project_id % 7 WHEN 0 THEN 'CVBS_U8' WHEN 1 THEN 'RAW_S16_28M' ELSE 'CVBS_U10_4FSC' END AS encoding,
 CASE project_id % 5 WHEN 0 THEN 'STANDARD_RAW' ELSE 'STANDARD_STABLE_LOCKED' END AS signal_state,
 CASE project_id % 4 WHEN 0 THEN 'yc' WHEN 1 THEN 'rgb' ELSE 'composite' END AS signal_type,
 CASE project_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'laserdisc' ELSE 'custom' END AS placement,
 CAST(CASE project_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 7.5 ELSE 5.0 END AS DOUBLE) AS black_setup_ire,
 CASE WHEN project_id % 2 = 0 THEN CAST(project_id % 10 AS INT) END AS efm_pair,
 CASE WHEN project_id % 19 = 0 THEN '' WHEN project_id % 8 = 0 THEN '{{output}}/p.cvbsy' ELSE '{{outptu}}/p.cvbs' END AS video_path
FROM {fx_project}""",
    "fx_section_config": """
SELECT s.*, p.standard, p.disc_type, CAST(duration_frames + 15 AS DOUBLE) AS noise_db, CAST(start_frame * 3 - 1 AS DOUBLE) AS noise_spread_db,
 dropout_scale AS random_scale, CAST(duration_repeat * 8 - 8 AS INT) AS scratch_scale, start_frame AS osd_scale,
 CASE WHEN start_frame = 4 THEN 'noise' WHEN start_frame = 3 THEN 'square' ELSE 'sine' END AS waveform,
 CAST(duration_frames * 500 AS DOUBLE) AS frequency_hz, CAST(start_frame AS DOUBLE) / 3.5 AS ramp_period_s, CAST(duration_frames % 10 AS INT) AS pair
FROM {fx_section} s LEFT JOIN {fx_project} p ON s.project_id = p.project_id""",
    "fx_code_config": """
SELECT c.*, p.standard, p.disc_type FROM {fx_section_code} c LEFT JOIN {fx_project} p ON c.project_id = p.project_id""",
    "fx_setting": """
SELECT project_id, section_no, standard,
 CASE c WHEN 0 THEN 'leadin' ELSE 'programme_area' END AS section_type, CASE c WHEN 1 THEN 'vits' ELSE 'vitc' END AS injection_type,
 CASE c WHEN 2 THEN 'sideways' ELSE 'up' END AS ramp_mode, CASE c WHEN 3 THEN 'red' ELSE 'white' END AS fg,
 CASE c WHEN 4 THEN 'red' ELSE 'transparent' END AS bg, CASE c WHEN 5 THEN 'chapter' ELSE 'users_code' END AS code_type,
 CAST(CASE c WHEN 6 THEN 21 ELSE 1 END AS INT) AS scratch_scale, CAST(CASE c WHEN 7 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS amplitude,
 CAST(CASE c WHEN 8 THEN -1 ELSE 100 END AS DOUBLE) AS ramp_start_hz, CAST(CASE c WHEN 9 THEN 22001 ELSE 100 END AS DOUBLE) AS ramp_end_hz,
 CAST(CASE c WHEN 10 THEN -0.5 ELSE 0.5 END AS DOUBLE) AS ramp_period_s,
 CAST(CASE c WHEN 11 THEN 80000 WHEN 12 THEN -1 WHEN 13 THEN 100000 ELSE 1 END AS INT) AS picture_start,
 CAST(CASE c WHEN 14 THEN 80000 ELSE 0 END AS INT) AS fm_start,
 CASE WHEN c = 20 THEN 'a.avi' WHEN exr THEN 'a.EXR' ELSE 'a.mkv' END AS source,
 CASE WHEN c = 21 THEN 'mov' WHEN exr THEN 'exr' ELSE 'matroska,webm' END AS container,
 CASE WHEN c = 22 THEN 'rgb24' WHEN exr THEN 'rgbf' ELSE 'yuv422p10le' END AS pixel_format,
 CAST(CASE WHEN c = 23 THEN 8 WHEN exr THEN 32 ELSE 10 END AS INT) AS bit_depth,
 CASE c WHEN 24 THEN 'bt709' ELSE 'smpte170m' END AS color_space,
 CASE WHEN c = 25 THEN 'tt' WHEN standard = 'PAL' THEN 'tb' ELSE 'bt' END AS field_order,
 CASE WHEN c = 26 THEN 'bt2020' WHEN standard = 'NTSC' THEN 'smpte170m' ELSE 'bt470bg' END AS color_primaries,
 CASE c WHEN 27 THEN 'linear' ELSE 'bt709' END AS color_transfer, CASE c WHEN 28 THEN 'pc' ELSE 'tv' END AS color_range,
 CAST(CASE c WHEN 29 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS sample_aspect, CAST(CASE c WHEN 30 THEN 2 ELSE 0 END AS INT) AS crop
FROM (SELECT l_orderkey AS project_id, CAST(l_linenumber AS INT) AS section_no, (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 60 AS c,
 l_partkey % 2 = 0 AS exr, CASE l_suppkey % 3 WHEN 0 THEN 'PAL' WHEN 1 THEN 'NTSC' ELSE 'PAL_M' END AS standard FROM {lineitem}) t""",
    "fx_code_case": """
SELECT l_orderkey AS project_id, CAST(l_linenumber AS INT) AS section_no,
 CASE l_partkey % 14 WHEN 0 THEN 'lead_in' WHEN 1 THEN 'lead_out' WHEN 2 THEN 'picture_number' WHEN 3 THEN 'picture_stop' WHEN 4 THEN 'chapter_number'
 WHEN 5 THEN 'programme_status' WHEN 6 THEN 'users_code' WHEN 7 THEN 'fm_picture_number' WHEN 8 THEN 'fm_white_flag' WHEN 9 THEN 'programme_time_code'
 WHEN 10 THEN 'clv_code' WHEN 11 THEN 'clv_picture_number' WHEN 12 THEN 'fm_programme_time' ELSE 'unheard_of' END AS code_type,
 CASE l_suppkey % 3 WHEN 0 THEN 'lead_in' WHEN 1 THEN 'programme_area' ELSE 'lead_out' END AS section_type,
 CASE l_linenumber % 3 WHEN 0 THEN 'CAV' WHEN 1 THEN 'CLV' END AS disc_type, CASE l_orderkey % 3 WHEN 0 THEN 'PAL' WHEN 1 THEN 'NTSC' ELSE 'PAL_M' END AS standard
FROM {lineitem}""",
    "fx_vits": """
SELECT l_orderkey AS project_id, CAST(1 + l_partkey % 640 AS INT) AS line_no, CASE l_suppkey % 5 WHEN 0 THEN 'virs' WHEN 1 THEN 'vits17' WHEN 2 THEN 'fcc-composite' WHEN 3 THEN 'uk-national' ELSE '' END AS vits_type FROM {lineitem}""",
    "fx_artefact_base": """
SELECT source AS suite, concat(source, '/', CAST(doc_id AS VARCHAR(20)), '.cvbs') AS path, sha2(text, 256) AS digest FROM {documents}""",
    "fx_artefact_cur": """
SELECT source AS suite, concat(source, '/', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 10 = 1 THEN '_v2.cvbs' ELSE '.cvbs' END) AS path,
 sha2(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END, 256) AS digest FROM {documents}""",
    "fx_sample": """
SELECT vec_id AS frame_id, label AS capture_id, pos, CAST(v AS DOUBLE) * 1000 AS mv FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, v) FROM {embeddings}) t""",
    "fx_line_array": """
SELECT vec_id AS frame_id, label AS capture_id, transform(embedding, v -> CAST(v AS DOUBLE) * 1000) AS samples FROM {embeddings}""",
    "fx_yc": """
SELECT vec_id AS frame_id, label AS capture_id, CASE label % 3 WHEN 0 THEN 'PAL' WHEN 1 THEN 'NTSC' ELSE 'PAL_M' END AS standard,
 transform(embedding, v -> CAST(v AS DOUBLE) * 4000) AS y, transform(reverse(embedding), v -> CAST(v AS DOUBLE) * 500) AS c FROM {embeddings}""",
    "fx_aligned": """
SELECT CAST(vec_id % 5 AS BIGINT) AS capture_id, CAST(floor(vec_id / 5) AS BIGINT) AS picture_number,
 transform(embedding, (v, i) -> CAST(CASE WHEN vec_id % 5 <= 1 THEN i WHEN vec_id % 5 = 2 AND i < 40 THEN i WHEN vec_id % 3 = 0 THEN i ELSE i + floor(v * 10) END AS INT)) AS samples FROM {embeddings}""",
}

# Texts for DuckDB where its function names differ.
DUCK_SQL: dict[str, str] = {
    "fx_artefact_base": SQL["fx_artefact_base"].replace("sha2(text, 256)", "sha256(text)"),
    "fx_artefact_cur": SQL["fx_artefact_cur"].replace("sha2(CASE", "sha256(CASE").replace("END, 256)", "END)"),
    "fx_sample": """
SELECT vec_id AS frame_id, label AS capture_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) * 1000 AS mv FROM {embeddings}""",
    "fx_line_array": """
SELECT vec_id AS frame_id, label AS capture_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 1000) AS samples FROM {embeddings}""",
    "fx_yc": """
SELECT vec_id AS frame_id, label AS capture_id, CASE label % 3 WHEN 0 THEN 'PAL' WHEN 1 THEN 'NTSC' ELSE 'PAL_M' END AS standard,
 list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 4000) AS y, list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE) * 500) AS c FROM {embeddings}""",
    "fx_aligned": """
SELECT CAST(vec_id % 5 AS BIGINT) AS capture_id, CAST(floor(vec_id / 5) AS BIGINT) AS picture_number,
 list_transform(embedding, lambda v, j: CAST(CASE WHEN vec_id % 5 <= 1 THEN j - 1 WHEN vec_id % 5 = 2 AND j - 1 < 40 THEN j - 1 WHEN vec_id % 3 = 0 THEN j - 1 ELSE j - 1 + floor(v * 10) END AS INT)) AS samples FROM {embeddings}""",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are a short list: they are brought together once, and all that follows by project needs no other shuffle of them.

    The number of partitions is stated, so that adaptive execution does not join them before sections multiply into frames.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return numbered(table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey"))


def numbered(lines: DataFrame) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    return lines.withColumn("section_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


def beside(name: str, keep: Sequence[str], **rows: DataFrame) -> DataFrame:
    """The view ``name`` over ``rows`` of the tables or views that its text reads, with their columns ``keep`` brought along."""
    text = re.sub(r"\bSELECT\b", f"SELECT {', '.join(keep)},", SQL[name])
    return next(iter(rows.values())).sparkSession.sql(text, **rows)


def sections_of(lines: DataFrame) -> DataFrame:
    """``fx_section`` of some lines; without ``section_no`` it is null, and they need no order."""
    rows = lines if "section_no" in lines.columns else lines.withColumn("section_no", F.lit(None).cast("int"))
    return lines.sparkSession.sql(SQL["fx_section"], fx_line_numbered=rows)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], {"rn": row_no()})


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = view(spark, sf_dir, "fx_section")
    placed = section_offsets(resolve_lengths(sections, F.broadcast(view(spark, sf_dir, "fx_source"))))  # at most 50 sources
    return placed.join(view(spark, sf_dir, "fx_project"), "project_id", "left")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of ``fx_section_code`` as one pass over the sections."""
    def code(flag: str, name: str, start: str | None = None) -> Column:
        value = F.col(start) if start else F.lit(None).cast("int")
        return F.when(F.col(flag), F.struct(F.lit(name).alias("code_type"), value.alias("start_value")))

    made = F.array_compact(F.array(
        code("declares_pn", "picture_number", "pn_anchor"), code("declares_chapter", "chapter_number", "chapter_anchor"),
        code("declares_status", "programme_status"), code("declares_user", "users_code"), code("declares_clv", "clv_code"),
    ))
    rows = view(spark, sf_dir, "fx_section").select("project_id", "section_no", "section_type", F.explode(made).alias("c"))
    return rows.select("project_id", "section_no", "section_type", "c.code_type", "c.start_value")


_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fx_line_numbered": _lines,
    "fx_event_numbered": _events,
    "fx_placed": _placed,
    "fx_section_code": _codes,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables in ``sf_dir`` as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name in _BUILDERS:
        return _BUILDERS[name](spark, sf_dir)
    text = SQL[name]
    refs = {ref: view(spark, sf_dir, ref) for ref in _REF.findall(text)}
    return spark.sql(text, **refs)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in seen:
            return
        for ref in _REF.findall(DUCK_SQL.get(name, SQL[name])):
            visit(ref)
        seen.append(name)

    for n in names:
        visit(n)
    return seen


def oracle(body: str) -> str:
    """DuckDB text: the views named in ``body`` as CTEs, then ``body`` (which may open with its own CTEs)."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    ctes = [f"{n} AS ({_plain(DUCK_SQL.get(n, SQL[n]))})" for n in _order(used)]
    body = body.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH" and body[4].isspace():
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _plain(text: str) -> str:
    return _REF.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
