"""Queries over code words."""

from __future__ import annotations

from pyspark.sql import functions as F

from framekit.dims import FLAG_LENGTH_H, FLAG_START_H, FM_START_H
from framekit.functions import words
from framekit.operators import timeline as tl
from framekit.operators import vbi
from framekit.plans.fixtures import view
from framekit.plans.registry import query

FLAGS = {
    "declares_pn": "picture_number", "declares_chapter": "chapter_number", "declares_status": "programme_status",
    "declares_user": "users_code", "declares_clv": "clv_code",
}
#: FM codes that the same flags declare.
FM_FLAGS = {"declares_pn": "fm_picture_number", "declares_clv": "fm_programme_time", "declares_user": "fm_white_flag"}
STATUS_WORD, USERS_WORD = 0x8DC1B5, 0x81D234

# One SQL branch per line and candidate, in priority order.
ASSIGN = """
 lines AS (SELECT section_type, disc_type, standard, l AS line_no, pos FROM (VALUES ('PAL', 313), ('NTSC', 263), ('PAL_M', 263)) s(standard, shift),
   (VALUES (10), (11), (16), (17), (18)) b(pos), (VALUES ('lead_in'), ('lead_out'), ('programme_area')) t(section_type), (VALUES ('CAV'), ('CLV')) d(disc_type), LATERAL (SELECT unnest([pos, pos + shift]) AS l) u),
 picked AS (SELECT p.*, line_no, CASE
   WHEN pos <= 11 AND p.standard = 'PAL' THEN NULL
   WHEN pos = 11 THEN CASE WHEN declares_user AND (line_no = 11 OR p.section_type = 'lead_out') THEN 'fm_white_flag' END
   WHEN pos = 10 AND p.section_type <> 'programme_area' THEN NULL
   WHEN pos = 10 AND p.disc_type = 'CAV' THEN CASE WHEN declares_pn THEN 'fm_picture_number' END
   WHEN pos = 10 THEN CASE WHEN declares_clv THEN 'fm_programme_time' END
   WHEN p.section_type <> 'programme_area' AND pos = 16 THEN CASE WHEN declares_user THEN 'users_code' END
   WHEN p.section_type <> 'programme_area' THEN p.section_type
   WHEN p.disc_type = 'CAV' AND pos = 16 THEN CASE WHEN declares_status THEN 'programme_status' END
   WHEN p.disc_type = 'CAV' AND pos = 17 THEN CASE WHEN declares_pn THEN 'picture_number' WHEN declares_chapter THEN 'chapter_number' END
   WHEN p.disc_type = 'CAV' THEN CASE WHEN declares_chapter THEN 'chapter_number' WHEN declares_pn THEN 'picture_number' END
   WHEN pos = 16 THEN CASE WHEN declares_status THEN 'programme_status' END
   WHEN pos = 17 THEN CASE WHEN declares_clv THEN 'clv_code' END
   ELSE CASE WHEN declares_chapter THEN 'chapter_number' END END AS code_type
  FROM fx_placed p JOIN lines l ON l.section_type = p.section_type AND l.disc_type = p.disc_type AND l.standard = p.standard WHERE carries_codes),
 assigned AS (SELECT *, CASE WHEN code_type = 'programme_status' OR (code_type = 'clv_code' AND standard <> 'PAL')
   THEN CAST(round(0.172 * CASE standard WHEN 'PAL' THEN 1135 WHEN 'NTSC' THEN 910 ELSE 909 END) AS INT)
   WHEN code_type = 'fm_white_flag' THEN CAST(round(FLAG_START * CASE standard WHEN 'NTSC' THEN 910 ELSE 909 END) AS INT)
   WHEN code_type LIKE 'fm_%' THEN CAST(round(FM_START * CASE standard WHEN 'NTSC' THEN 910 ELSE 909 END) AS INT) ELSE 0 END AS start_sample,
   CASE WHEN code_type = 'fm_white_flag' THEN CAST(round(FLAG_LENGTH * CASE standard WHEN 'NTSC' THEN 910 ELSE 909 END) AS INT) END AS flag_length FROM picked WHERE code_type IS NOT NULL)""".replace("FLAG_START", str(FLAG_START_H)).replace("FM_START", str(FM_START_H)).replace("FLAG_LENGTH", str(FLAG_LENGTH_H))


def coded_sections(placed):
    codes = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for flag, name in [*FLAGS.items(), *FM_FLAGS.items()]]))
    return placed.filter("carries_codes").withColumn("code_types", codes)


@query("assign_line_codes", f"WITH {ASSIGN} SELECT project_id, section_no, CAST(line_no AS INT) AS line_no, code_type, start_sample, flag_length FROM assigned")
def assign_line_codes(spark, sf):
    return vbi.assign_line_codes(coded_sections(view(spark, sf, "fx_placed"))).select(
        "project_id", "section_no", "line_no", "code_type", "start_sample", "flag_length"
    )


@query("expected_words", f"""WITH {ASSIGN},
 a AS (SELECT *, CASE WHEN carries_codes THEN n_frames ELSE 0 END AS adv, CASE WHEN declares_pn THEN pn_anchor END AS anc, CASE WHEN declares_chapter THEN chapter_anchor END AS canc FROM fx_placed),
 b AS (SELECT *, coalesce(sum(adv) OVER w, 0) AS pre, coalesce(sum(CASE WHEN declares_pn THEN 1 ELSE 0 END) OVER w, 0) AS seen, coalesce(sum(CASE WHEN declares_chapter THEN 1 ELSE 0 END) OVER w, 0) AS cseen
   FROM a WINDOW w AS (PARTITION BY project_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, coalesce(anc, CASE WHEN declares_pn AND seen = 0 THEN 1 END) AS beg, coalesce(canc, CASE WHEN declares_chapter AND cseen = 0 THEN 0 END) AS cbeg FROM b),
 d AS (SELECT project_id, section_no, pre, last_value(beg - pre IGNORE NULLS) OVER w AS base, last_value(cbeg IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN cbeg IS NOT NULL THEN pre END IGNORE NULLS) OVER w AS cpre
   FROM c WINDOW w AS (PARTITION BY project_id ORDER BY section_no ROWS UNBOUNDED PRECEDING)),
 fa AS (SELECT *, CASE WHEN declares_pn THEN coalesce(pn_anchor, 1) END AS fst, CASE WHEN carries_codes AND section_type = 'programme_area' THEN n_frames ELSE 0 END AS pf,
   sum(CASE WHEN declares_pn THEN 1 ELSE 0 END) OVER w AS sp, sum(CASE WHEN declares_clv THEN 1 ELSE 0 END) OVER w AS stm FROM fx_placed WINDOW w AS (PARTITION BY project_id ORDER BY section_no ROWS UNBOUNDED PRECEDING)),
 fb AS (SELECT project_id, section_no, first_value(fst IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY section_no ROWS UNBOUNDED PRECEDING)
   + coalesce(sum(CASE WHEN sp > 0 THEN pf ELSE 0 END) OVER v, 0) AS fmp, coalesce(sum(CASE WHEN stm > 0 THEN pf ELSE 0 END) OVER v, 0) AS fmt
   FROM fa WINDOW v AS (PARTITION BY project_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT s.project_id, s.section_no, line_no, code_type, standard, flag_length, i, least(fmp + i, 79999) AS fn, (fmt + i) // 30 AS fs, first_frame + i AS frame_id, least(base + pre + i, CASE standard WHEN 'NTSC' THEN 79999 ELSE 99999 END) AS pn, chapter, CASE WHEN pre - cpre + i >= 400 THEN 8 ELSE 0 END AS stop
   FROM (SELECT * FROM assigned WHERE standard = 'NTSC' OR code_type NOT IN ('fm_picture_number', 'fm_programme_time')) s JOIN d USING (project_id, section_no) JOIN fb USING (project_id, section_no), LATERAL (SELECT unnest(range(n_frames)) AS i) u),
 x AS (SELECT *, CASE code_type WHEN 'fm_picture_number' THEN [fn // 10000, fn // 1000 % 10, fn // 100 % 10, fn // 10 % 10, fn % 10]
   WHEN 'fm_programme_time' THEN [fs // 60 % 60 // 10, fs // 60 % 60 % 10, fs % 60 // 10, fs % 10, 13] END AS dg FROM f),
 r AS (SELECT *, list_transform(dg, lambda n: n % 2 * 8 + n // 2 % 2 * 4 + n // 4 % 2 * 2 + n // 8) AS rv FROM x),
 m AS (SELECT *, rv[5] * 65536 + rv[4] * 4096 + rv[3] * 256 + rv[2] * 16 + rv[1] AS data FROM r),
 w AS (SELECT *, CASE code_type WHEN 'fm_white_flag' THEN NULL
   WHEN 'fm_picture_number' THEN (((3 * 2 + CASE WHEN line_no <= 262 THEN 1 ELSE 0 END) * 128 + 114) * 1048576 + data) * 256 + (1 - bit_count(data) % 2) * 128 + 13
   WHEN 'fm_programme_time' THEN (((3 * 2 + CASE WHEN line_no <= 262 THEN 1 ELSE 0 END) * 128 + 114) * 1048576 + data) * 256 + (1 - bit_count(data) % 2) * 128 + 13
   WHEN 'lead_in' THEN 8978431 WHEN 'lead_out' THEN 8449774 WHEN 'clv_code' THEN 8912895 WHEN 'programme_status' THEN {STATUS_WORD} WHEN 'users_code' THEN {USERS_WORD}
   WHEN 'picture_number' THEN 15728640 + pn // 10000 * 65536 + pn // 1000 % 10 * 4096 + pn // 100 % 10 * 256 + pn // 10 % 10 * 16 + pn % 10
   ELSE 8388608 + (stop + chapter // 16) * 65536 + chapter % 16 * 4096 + 3549 END AS word FROM m)
SELECT project_id, section_no, CAST(line_no AS INT) AS line_no, code_type, count(*) AS n_words, CAST(sum(word) AS BIGINT) AS sum_words, CAST(sum((i + 1) * word) AS BIGINT) AS weighted_words, CAST(max(word) AS BIGINT) AS last_word,
 CAST(max(flag_length) AS INT) AS flag_length FROM w WHERE word IS NOT NULL OR code_type = 'fm_white_flag' GROUP BY 1, 2, 3, 4""")
def expected_words(spark, sf):
    flagged = view(spark, sf, "fx_placed").withColumns({"declares_fm_picture": F.col("declares_pn"), "declares_fm_time": F.col("declares_clv")})
    state = tl.fm_state(tl.chapter_state(tl.assign_picture_numbers(flagged)))
    sections = coded_sections(state).select(
        "project_id", "section_no", "standard", "section_type", "disc_type", "code_types", "n_frames", "pass_length", "first_frame", "start_frame",
        "first_picture", "picture_step", "chapter", "chapter_frames", "chapter_step", "fm_picture_first", "fm_time_first",
        F.lit(STATUS_WORD).alias("status_word"), F.lit(USERS_WORD).alias("users_word"),
    )
    place = F.col("in_section") + 1
    return vbi.expected_words(sections).groupBy("project_id", "section_no", "line_no", "code_type").agg(
        F.count("*").alias("n_words"), F.sum("word").alias("sum_words"), F.sum(place * F.col("word")).alias("weighted_words"),
        F.max("word").alias("last_word"), F.max("flag_length").alias("flag_length"),
    )


DECODED = """
 n AS (SELECT *, word >> 20 AS k, word >> 16 & 15 AS a, word >> 12 & 15 AS b, word >> 8 & 15 AS c, word >> 4 & 15 AS d, word & 15 AS e FROM fx_word),
 dec AS (SELECT *, CASE WHEN word = 8978431 THEN 'lead_in' WHEN word = 8449774 THEN 'lead_out' WHEN word = 8572927 THEN 'picture_stop' WHEN word = 8912895 THEN 'clv_code'
   WHEN k = 8 AND c = 13 AND d = 13 AND e = 13 THEN 'chapter_number' WHEN k = 8 AND ((a = 13 AND b = 12) OR (a = 11 AND b = 10)) THEN 'programme_status'
   WHEN k = 8 AND a >= 10 AND b = 14 AND c <= 9 AND d <= 9 AND e <= 9 THEN 'clv_picture_number' WHEN k = 8 AND a <= 7 AND b = 13 THEN 'users_code'
   WHEN k = 15 AND b = 13 AND c = 13 AND d <= 9 AND e <= 9 THEN 'programme_time_code' WHEN k = 15 AND b <= 9 AND c <= 9 AND d <= 9 AND e <= 9 THEN 'picture_number' ELSE 'unknown' END AS code_type FROM n)"""


@query("word_mismatches", """WITH
 e AS (SELECT capture_id, frame_id, 15728640 + picture_number // 10000 * 65536 + picture_number // 1000 % 10 * 4096 + picture_number // 100 % 10 * 256 + picture_number // 10 % 10 * 16 + picture_number % 10 AS word FROM fx_capture_frame),
 x AS (SELECT capture_id, frame_id, 17 AS line_no, word FROM e UNION ALL SELECT capture_id, frame_id, 19, word FROM e)
SELECT capture_id, frame_id, CAST(line_no AS INT) AS line_no, CAST(x.word AS INT) AS expected_word, w.word AS captured_word FROM x FULL JOIN fx_word w USING (capture_id, frame_id, line_no) WHERE x.word IS DISTINCT FROM w.word""")
def word_mismatches(spark, sf):
    frames = view(spark, sf, "fx_capture_frame")
    expected = frames.select(
        "capture_id", "frame_id", F.explode(F.array(F.lit(17), F.lit(19))).alias("line_no"),
        words.picture_word(F.col("picture_number")).cast("int").alias("word"),
    )
    return vbi.word_mismatches(expected, view(spark, sf, "fx_word"), ["capture_id", "frame_id", "line_no"])


@query("decode_code_words", f"""WITH {DECODED}
SELECT capture_id, frame_id, line_no, word, code_type, CASE WHEN code_type = 'picture_number' THEN a * 10000 + b * 1000 + c * 100 + d * 10 + e END AS picture_number,
 CASE WHEN code_type = 'chapter_number' THEN (a & 7) * 16 + b END AS chapter, CASE WHEN code_type = 'chapter_number' THEN a >> 3 END AS stop_bit,
 CASE WHEN code_type = 'programme_time_code' THEN a END AS hour, CASE WHEN code_type = 'programme_time_code' THEN d * 10 + e END AS minute,
 CASE WHEN code_type = 'clv_picture_number' THEN (a - 10) * 10 + c END AS clv_second, CASE WHEN code_type = 'clv_picture_number' THEN d * 10 + e END AS clv_frame,
 CASE WHEN code_type = 'programme_status' THEN d END AS status_x4 FROM dec""")
def decode_code_words(spark, sf):
    return vbi.decode_code_words(view(spark, sf, "fx_word"))


@query("vote_frame_codes", f"""WITH {DECODED},
 c AS (SELECT capture_id, frame_id, code_type, word, count(*) AS n FROM dec GROUP BY 1, 2, 3, 4),
 r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame_id, code_type ORDER BY n DESC, word) AS rn, sum(n) OVER (PARTITION BY capture_id, frame_id, code_type) AS votes FROM c)
SELECT capture_id, frame_id, code_type, word, CAST(votes AS BIGINT) AS votes, round(n / votes::DOUBLE, 6) AS agreement FROM r WHERE rn = 1""")
def vote_frame_codes(spark, sf):
    return vbi.vote_frame_codes(view(spark, sf, "fx_word"))


@query("picture_number_continuity", """WITH
 l AS (SELECT *, lag(picture_number) OVER (PARTITION BY capture_id ORDER BY frame_id) AS previous FROM fx_capture_frame)
SELECT capture_id, frame_id, picture_number, previous, CASE WHEN previous IS NULL THEN 'start' WHEN picture_number = previous + 1 THEN 'contiguous' WHEN picture_number = previous THEN 'repeat'
 WHEN picture_number < previous THEN 'backward_skip' ELSE 'forward_gap' END AS step_class, CAST(CASE WHEN picture_number > previous + 1 THEN picture_number - previous - 1 ELSE 0 END AS BIGINT) AS missing FROM l""")
def picture_number_continuity(spark, sf):
    return vbi.picture_number_continuity(view(spark, sf, "fx_capture_frame"))


@query("frame_map", """WITH
 s AS (SELECT capture_id, min(picture_number) AS lo, max(picture_number) AS hi FROM fx_capture_frame GROUP BY 1),
 n AS (SELECT capture_id, unnest(range(lo, hi + 1)) AS picture_number FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, picture_number ORDER BY frame_id DESC) AS rn, count(*) OVER (PARTITION BY capture_id, picture_number) AS passes FROM fx_capture_frame)
SELECT n.capture_id, n.picture_number, r.frame_id, coalesce(passes, 0) AS passes, r.frame_id IS NULL AS is_pad FROM n LEFT JOIN r ON r.capture_id = n.capture_id AND r.picture_number = n.picture_number AND rn = 1""")
def frame_map(spark, sf):
    return vbi.frame_map(view(spark, sf, "fx_capture_frame").select("capture_id", "frame_id", "picture_number"))


@query("verify_checksums", """WITH
 s AS (SELECT event_id, 9289728 + (event_id % 16) * 16 + (event_id // 16) % 16 AS word FROM events),
 h AS (SELECT *, word >> 4 & 15 AS x, word & 15 AS e FROM s),
 hs AS (SELECT *, (x >> 3 & 1) AS d1, (x >> 2 & 1) AS d2, (x >> 1 & 1) AS d3, (x & 1) AS d4 FROM h),
 st AS (SELECT event_id, xor(xor(d1, d2), d4) * 8 + xor(xor(d1, d3), d4) * 4 + xor(xor(d2, d3), d4) * 2 + xor(xor(d1, d2), d3) = e AS ok FROM hs),
 f AS (SELECT event_id, bit_count((event_id * 2654435761) >> 7 & 2097151) % 2 = 1 AS ok FROM events),
 q AS (SELECT event_id, list_transform(range(10), lambda j: (event_id * (j + 3) + j * 7) % 256) AS bytes FROM events),
 qb AS (SELECT event_id, bytes, list_transform(range(80), lambda i: (bytes[i // 8 + 1] >> (7 - i % 8)) & 1) AS bits FROM q),
 qc AS (SELECT event_id, xor(list_reduce(list_prepend(0::BIGINT, bits), lambda r, b: CASE WHEN (r >> 15 & 1) <> b THEN xor(r * 2 % 65536, 4129) ELSE r * 2 % 65536 END), 65535) AS crc FROM qb)
SELECT 'status' AS kind, ok AS check_ok, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS sum_key FROM st GROUP BY 2
UNION ALL SELECT 'fm', ok, count(*), CAST(sum(event_id) AS BIGINT) FROM f GROUP BY 2
UNION ALL SELECT 'q', event_id % 5 <> 0, count(*), CAST(sum(crc) AS BIGINT) FROM qc GROUP BY 2""")
def verify_checksums(spark, sf):
    e = F.col("event_id")
    events = view(spark, sf, "events").select("event_id")
    status = events.withColumn("word", (9289728 + (e % 16) * 16 + F.expr("(event_id div 16) % 16")).cast("int"))
    fm = events.withColumn("fm_word", e * 2654435761)
    payload = F.array(*[((e * (j + 3) + j * 7) % 256).cast("int") for j in range(10)])
    q = events.withColumn("payload", payload).withColumn("true_crc", words.q_crc(F.col("payload"))).withColumn(
        "crc", F.col("true_crc").bitwiseXOR(F.when(e % 5 == 0, 1).otherwise(0))
    )
    out = []
    for kind, rows, key in (("status", status, "event_id"), ("fm", fm, "event_id"), ("q", q, "true_crc")):
        out.append(
            vbi.verify_checksums(rows, kind).groupBy("check_ok")
            .agg(F.count("*").alias("n"), F.sum(key).cast("bigint").alias("sum_key"))
            .select(F.lit(kind).alias("kind"), "check_ok", "n", "sum_key")
        )
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("code_coverage", f"""WITH {DECODED}
SELECT capture_id, code_type, count(DISTINCT frame_id) AS n_frames, count(*) AS n_words, round(sum(word >> 23 & 1) * 100.0 / count(*), 6)::DOUBLE AS key_ok_percent FROM dec GROUP BY 1, 2""")
def code_coverage(spark, sf):
    return vbi.code_coverage(view(spark, sf, "fx_word"))
