import pytest
from pyspark.sql import functions as F

from framekit.functions import words
from framekit.operators import samples as sm
from framekit.operators import vbi


def test_words_round_trip(spark):
    df = spark.range(0, 80000, 37).select(F.col("id").alias("n"))
    coded = df.select(
        "n", F.explode(F.array(
            words.picture_word(F.col("n")), words.chapter_word(F.col("n") % 80, F.col("n") % 2),
            words.programme_time_word(F.col("n") % 10, F.col("n") % 60), words.clv_picture_word(F.col("n") % 60, F.col("n") % 30),
        )).alias("word"),
    ).withColumn("word", F.col("word").cast("int"))
    rows = vbi.decode_code_words(coded).collect()
    for r in rows:
        if r.code_type == "picture_number":
            assert r.picture_number == r.n
        elif r.code_type == "chapter_number":
            assert (r.chapter, r.stop_bit) == (r.n % 80, r.n % 2)
        elif r.code_type == "programme_time_code":
            assert (r.hour, r.minute) == (r.n % 10, r.n % 60)
        else:
            assert r.code_type == "clv_picture_number" and (r.clv_second, r.clv_frame) == (r.n % 60, r.n % 30)


def test_fixed_words(spark):
    df = spark.createDataFrame([(0x88FFFF,), (0x80EEEE,), (0x82CFFF,), (0x87FFFF,), (0x8DC1B5,), (0x81D234,), (0x123456,)], "word int")
    got = [r.code_type for r in vbi.decode_code_words(df).collect()]
    assert got == ["lead_in", "lead_out", "picture_stop", "clv_code", "programme_status", "users_code", "unknown"]


def test_fm_word_layout_and_parity(spark):
    digits = [F.lit(d) for d in (1, 2, 3, 4, 5)]
    row = spark.range(1).select(words.fm_word(F.lit(True), digits).alias("fm_word")).first()
    data = "".join(format(d, "04b")[::-1] for d in (5, 4, 3, 2, 1))
    parity = "0" if data.count("1") % 2 else "1"
    assert format(row.fm_word, "040b") == "0011" + "1" + "1110010" + data + parity + "0001101"
    flipped = spark.createDataFrame([(row.fm_word,), (row.fm_word ^ (1 << 10),)], "fm_word bigint")
    assert [r.check_ok for r in vbi.verify_checksums(flipped, "fm").collect()] == [True, False]


@pytest.mark.parametrize("standard,mv,code", [
    ("PAL", 0.0, 256), ("PAL", 700.0, 844), ("PAL", -300.0, 4), ("PAL", -1000.0, 4), ("PAL", 2000.0, 1019),
])
def test_literal_codes(spark, standard, mv, code):
    df = spark.createDataFrame([(standard, [mv])], "standard string, y array<double>")
    assert abs(sm.quantise_samples(df, "CVBS_U10_4FSC").first().codes[0] - code) <= 1


def test_nonstandard_flag(spark):
    df = spark.createDataFrame([(1, 7, "PAL", [0.0, 2000.0]), (2, 3, "PAL", [0.0, 700.0])], "f int, frame_id bigint, standard string, y array<double>")
    got = {r.f: r for r in sm.nonstandard_rollup(df, ["f"]).collect()}
    assert got[1].has_nonstandard and (got[1].first_frame, got[1].first_sample) == (7, 1)
    assert not got[2].has_nonstandard and got[2].first_frame is None


def test_whole_frame_resampling_equals_the_line_form(spark):
    df = spark.createDataFrame([(1, [0, 10, -20, 37, 5]), (2, [9]), (3, [4, 4, -7])], "i int, samples array<bigint>")
    for n in (1, 2, 7, 40):
        assert sorted(sm.resample_linear(df, n).collect()) == sorted(sm.resample_frames(df, n).collect())


def test_16_bit_rounding(spark):
    df = spark.createDataFrame([([8388607, -8388608, 128, -128, 127, 0],)], "samples array<int>")
    row = sm.requantise_24_to_16(df).first()
    assert row.samples == [32767, -32768, 1, -1, 0, 0] and row.n_saturated == 1


def test_nonstandard_values_by_signal_type_and_line(spark):
    rows = [(1, 7, 1, "PAL", [100.0] * 5, [0.0] * 5), (1, 7, 2, "PAL", [100.0, 100.0, 850.0, 100.0, 100.0], [0.0, 0.0, 300.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "capture_id bigint, frame_id bigint, line int, standard string, y array<double>, c array<double>")
    whole = sm.nonstandard_rollup(df, ["capture_id"], line="line").first()
    assert tuple(whole) == (1, True, 1, 7, 2, 2)
    assert sm.nonstandard_rollup(df, ["capture_id"], signal_type="yc", line="line").first().has_nonstandard is False
    assert sm.nonstandard_rollup(df, ["capture_id"], encoding="RAW_S16_28M", line="line").first().has_nonstandard is False
    far = spark.createDataFrame([(1, 7, "PAL", [100.0] * 1_100_000 + [2000.0])], "capture_id bigint, frame_id bigint, standard string, y array<double>")
    got = sm.nonstandard_rollup(far, ["capture_id"]).first()
    assert (got.first_frame, got.first_sample) == (7, 1_100_000)


def test_votes_on_wide_and_missing_words(spark):
    wide = (1 << 39) + 5
    df = spark.createDataFrame([(1, 0, wide), (1, 0, wide), (1, 0, wide + 1), (1, 1, None), (1, 1, None)], "capture_id bigint, frame_id bigint, word bigint")
    got = {(r.frame_id, r.word): (r.votes, r.agreement) for r in vbi.vote_frame_codes(df).collect()}
    assert (1, None) in got and got[1, None] == (2, 1.0)
    assert [w for f, w in got if f == 0] and all(w is None or w >= wide for _, w in got)


def test_pixels_do_not_carry_their_row(spark):
    df = spark.createDataFrame([(1, 0, [0.1, 0.5, 0.9], [0.1, 0.5, 0.9], [0.1, 0.5, 0.9])], "image_id bigint, y int, r array<double>, g array<double>, b array<double>")
    out = sm.component_stats(df)
    assert out.first().n == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate" in line]
    assert generates and all("[image_id" in line and "__s" not in line.split("],")[-2] for line in generates)


def test_words_of_lines_need_no_shuffle_and_compile(spark):
    """Given assignments bring the same words; methods over 8,000 bytes are never compiled by the JVM."""
    import re

    from framekit.operators import vbi
    from framekit.plans import catalog
    from pyspark.sql import functions as F

    sections = spark.sql("""SELECT 1L project_id, n section_no, s standard, t section_type, d disc_type, 40L n_frames, 40L pass_length, n * 40L first_frame, 0 start_frame,
     7990L + n first_picture, 1L picture_step, 20L chapter, 380L chapter_frames, 1L chapter_step, 79970L fm_picture_first, 107970L fm_time_first, 1 status_word, 2 users_word,
     array('picture_number', 'chapter_number', 'users_code', 'clv_code', 'programme_time_code', 'clv_picture_number', 'fm_picture_number', 'fm_programme_time', 'fm_white_flag') code_types
     FROM (SELECT explode(array('PAL', 'NTSC', 'PAL_M')) s, 1 n) CROSS JOIN (SELECT explode(array('lead_in', 'programme_area')) t) CROSS JOIN (SELECT explode(array('CAV', 'CLV')) d)""").withColumn(
        "section_no", F.monotonically_increasing_id().cast("int"))
    sections = spark.createDataFrame(sections.collect(), sections.schema)
    one = vbi.expected_words(sections).collect()
    two = vbi.expected_words(sections, vbi.assign_line_codes(sections)).collect()
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) > 1000
    fm = next(r for r in one if r.code_type == "fm_programme_time" and r.in_section == 0 and r.line_no == 10)
    digits = [F.lit(d) for d in (5, 9, 5, 9, 13)]  # 107970 // 30 = 3599 s: 59:59
    from framekit.functions import words

    assert fm.word == spark.range(1).select(words.fm_word(F.lit(True), digits)).first()[0]
    plan = catalog.QUERIES["expected_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert not re.search(r"Exchange hashpartitioning\([^)]*section_no", plan.executedPlan().toString())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = catalog.QUERIES["expected_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        text = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) <= 8000
