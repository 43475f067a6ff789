from pyspark.sql import functions as F

from framekit.functions import clocks
from framekit.operators import timeline as tl

SECTION = (
    "project_id bigint, section_no int, section_type string, source string, duration_frames int, duration_all boolean, "
    "duration_repeat int, start_frame int, standard string, carries_codes boolean, declares_pn boolean, pn_anchor int"
)


def sections(spark):
    rows = [
        (1, 1, "lead_in", "a", 3, False, 1, 0, "PAL", False, False, None),
        (1, 2, "programme_area", "b", 0, True, 2, 5, "PAL", True, True, None),
        (1, 3, "programme_area", "a", 2, False, 1, 0, "PAL", True, False, None),
        (1, 4, "programme_area", "a", 2, False, 1, 0, "PAL", False, True, None),
        (1, 5, "programme_area", "a", 3, False, 1, 0, "PAL", True, True, 99998),
        (1, 6, "lead_out", "a", 1, False, 1, 0, "PAL", True, False, None),
    ]
    return spark.createDataFrame(rows, SECTION)


def placed(spark):
    sources = spark.createDataFrame([("b", 4)], "source string, frame_count int")
    return tl.section_offsets(tl.resolve_lengths(sections(spark), sources))


def test_open_sections_repeat_their_source(spark):
    frames = tl.expand_placed(placed(spark)).filter("section_no = 2").orderBy("frame_id").collect()
    assert [f.frame_id for f in frames] == list(range(3, 11))
    assert [f.source_frame_index for f in frames] == [5, 6, 7, 8, 5, 6, 7, 8]


def test_bounds_clip_the_expansion(spark):
    whole = tl.expand_placed(placed(spark)).filter("frame_id >= 4 and frame_id < 13").select("frame_id", "section_no", "source_frame_index")
    part = tl.expand_placed(placed(spark), 4, 13).select("frame_id", "section_no", "source_frame_index")
    assert sorted(part.collect()) == sorted(whole.collect())


def numbers(spark, mode):
    rows = tl.expand_placed(tl.assign_picture_numbers(placed(spark), mode)).withColumn("n", tl.picture_number())
    return {k: [r.n for r in sorted(v, key=lambda r: r.frame_id)] for k, v in _group(rows.collect()).items()}


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.section_no, []).append(r)
    return out


def test_picture_numbers_carry_anchor_and_saturate(spark):
    got = numbers(spark, "carried")
    assert got[1] == [None] * 3
    assert got[2] == list(range(1, 9))
    assert got[3] == [9, 10]
    assert got[4] == [11, 11]
    assert got[5] == [99998, 99999, 99999]
    assert got[6] == [99999]
    assert numbers(spark, "schedule")[2] == [0] * 8
    disc = numbers(spark, "disc")
    assert disc[1] == [None] * 3 and disc[2][0] == 1 and disc[3] == [1, 2]


def test_clv_closed_form_equals_stepping(spark):
    n = 40000
    points = {8991 * k + 899 * m for k in range(n // 8991 + 1) for m in range(10)} - {0}
    want, sec, frame = [], 0, 0
    for i in range(n):
        if i:
            if i in points:
                sec, frame = (sec + 1) % 60, 0
            else:
                frame += 1
                if frame == 30:
                    sec, frame = (sec + 1) % 60, 0
        want.append((sec, frame))
    rows = spark.range(n).select("id", F.lit("NTSC").alias("standard"))
    got = tl.clv_picture_number(rows, "id").orderBy("id").select("clv_second", "clv_frame").collect()
    assert [tuple(r) for r in got] == want


def test_audio_cadence_sums(spark):
    rows = spark.createDataFrame([("NTSC",), ("PAL",), ("PAL_M",)], "standard string")
    got = {r.standard: r for r in rows.select(
        "standard", clocks.audio_offset_44k(F.lit(100)).alias("a"), clocks.audio_offset_48k(F.lit(5)).alias("b")
    ).collect()}
    assert (got["NTSC"].a, got["NTSC"].b) == (147147, 8008)
    assert (got["PAL"].a, got["PAL"].b) == (176400, 9600)
    assert got["PAL_M"].a is None


def test_runs_may_recur_when_asked(spark):
    kinds = ["lead_in", "lead_in", "programme_area", "programme_area", "programme_area", "lead_out", "lead_out"]
    numbers_ = [1, 2, 3, 4, 3, 5, 6]
    rows = [(9, i, numbers_[i], kinds[i]) for i in range(7)]
    df = spark.createDataFrame(rows, "project_id bigint, frame_id bigint, section_no int, section_type string")
    got = sorted((r.start_frame_id, r.section_no, r.n_frames) for r in tl.section_runs(df, contiguous=False).collect())
    assert got == [(0, 1, 2), (2, 3, 1), (3, 4, 1), (4, 3, 1), (5, 5, 2)]


def test_codes_array_becomes_flags(spark):
    df = spark.sql(
        "SELECT 1 project_id, 1 section_no, array(named_struct('code_type', 'picture_number', 'start_value', 7, 'chapter', CAST(NULL AS INT))) codes"
    )
    row = tl.flatten_codes(df).first()
    assert row.carries_codes and row.declares_pn and row.pn_anchor == 7 and not row.declares_chapter


def test_chunks_apart_give_the_same_frames(spark):
    one, two = (tl.expand_placed(placed(spark), apart=a).select("section_no", "in_section", "frame_id", "source_frame_index").collect() for a in (False, True))
    assert sorted(one) == sorted(two)


def test_totals_of_placed_sections_equal_those_of_frames(spark):
    count = F.col("frame_id") * 3 + 1
    keys = ["project_id", "section_no", "frame_id"]
    want = tl.run_totals(tl.expand_placed(placed(spark)).select(*keys, count.alias("n")), "n")
    got = tl.placed_run_totals(placed(spark), count).select(*keys, F.col("count").alias("n"), "run_total", "is_run_start")
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_frames_of_placed_sections_and_of_empty_ones(spark):
    rows = placed(spark).withColumn("n_frames", F.when(F.col("section_no") == 3, 0).when(F.col("section_no") != 4, F.col("n_frames")))
    got = {r.section_no: r.first_frame_id for r in tl.first_frame_of_section(rows).collect()}
    want = {r.section_no: r.first_frame_id for r in tl.first_frame_of_section(rows, tl.expand_placed(rows)).collect()}
    assert got == want and got[3] == got[4] == -1


def test_the_greatest_time_is_that_of_the_greatest_number(spark):
    at = spark.createDataFrame([(s,) for s in (0, 74, 4499, 4500, 449999, 450000, 451234, 899999)], "s bigint")
    row = at.agg(F.max(clocks.msf(F.col("s"))).alias("text"), clocks.msf(F.max(clocks.msf_order(F.col("s")))).alias("number")).first()
    assert row.text == row.number == "99:59:74"
    low = at.filter("s in (74, 4499, 450000)").agg(F.max(clocks.msf(F.col("s"))).alias("text"), clocks.msf(F.max(clocks.msf_order(F.col("s")))).alias("number")).first()
    assert low.text == low.number


def test_queries_shuffle_the_sections_once_and_no_frames(spark):
    from framekit.plans import catalog

    for slug in (
        "subcode_timeline", "run_totals", "programme_only_counter", "first_frame_of_section", "assign_picture_numbers", "track_table",
        "sequence_phase", "assign_line_codes", "next_section", "chapter_state", "mute_overlap", "track_table_errors",
    ):
        plan = catalog.QUERIES[slug](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("section_no" in line.split(", ENSURE")[0].split("REPARTITION")[0] for line in moved), slug
        assert "SortAggregate" not in plan, slug
        assert sum("REPARTITION_BY_NUM" in line for line in moved) <= (2 if slug in ("mute_overlap", "track_table_errors") else 1), slug


def test_sketches_see_each_clean_frame_once(spark):
    from framekit.operators import compare as cmp

    frames = spark.range(3000).select(F.lit("a.mkv").alias("source"), F.lit("programme_area").alias("section_type"), (F.col("id") % 100).alias("source_frame_index"), (F.col("id") % 4).cast("bigint").alias("sequence_phase"))
    for made in (cmp.distinct_sketches(frames), cmp.approx_distinct_frames(frames)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 2  # distinct frames, then their sketch
    assert cmp.merge_sketches(cmp.distinct_sketches(frames)).first().n_distinct_approx in (99, 100, 101)
    assert cmp.approx_distinct_frames(frames).first().n_distinct_approx in range(97, 104)
