import numpy as np
import pytest
from pyspark.sql import functions as F

from framekit.operators import compare, rules, text
from framekit.sources import logs, raw_frames, sidecar


def test_raw_files_are_split_and_checked(spark, tmp_path, monkeypatch):
    codes = np.arange(64 * 50, dtype="<i2").reshape(50, 64)
    (tmp_path / "a.raw").write_bytes(codes.tobytes())
    reader = raw_frames.RawFrameReader({"path": f"file://{tmp_path}", "framesamples": "64"})
    monkeypatch.setattr(raw_frames, "TASK_BYTES", 128 * 20)
    monkeypatch.setattr(raw_frames, "OPEN_BYTES", 0)
    assert [[r[1:3] for r in p.ranges] for p in reader.partitions()] == [[(0, 20)], [(20, 20)], [(40, 10)]]
    rows = raw_frames.read_raw_frames(spark, str(tmp_path), samples=64).orderBy("frame_id").collect()
    assert len(rows) == 50 and rows[49].samples == codes[49].tolist()
    (tmp_path / "b.raw").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError):
        reader.partitions()


def test_written_frames_keep_their_numbers(spark, tmp_path):
    numbers = [0, 1, 2, 7, 8, 31, 32, 33]
    frames = spark.createDataFrame([(5, f, [f, f + 1]) for f in numbers], "capture_id bigint, frame_id bigint, codes array<smallint>")
    for _ in range(2):  # a second run replaces the files
        files = raw_frames.write_raw_frames(frames, str(tmp_path), per_file=32).collect()
    assert sorted((r.first_frame, r.n_frames, r.gaps) for r in files) == [(0, 6, True), (32, 2, False)]
    got = raw_frames.read_raw_frames(spark, str(tmp_path), samples=2, suffix=".raw").orderBy("frame_id").collect()
    assert [(r.frame_id, list(r.samples)) for r in got] == [(f, [f, f + 1]) for f in numbers]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = raw_frames.read_raw_frames(spark, str(tmp_path), samples=2, suffix=".raw").filter("frame_id > 1 and frame_id <= 7")
        assert sorted(r.frame_id for r in some.collect()) == [2, 7]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = raw_frames.FilteredRawFrameReader({"path": f"file://{tmp_path}", "framesamples": "2", "suffix": ".raw"})
    assert len(list(reader.pushFilters([GreaterThan(("frame_id",), 1), LessThanOrEqual(("frame_id",), 7)]))) == 2
    assert [r[1:] for p in reader.partitions() for r in p.ranges] == [(0, 6, True)]  # one with gaps is read whole or not at all
    reader = raw_frames.FilteredRawFrameReader({"path": f"file://{tmp_path}", "framesamples": "2", "suffix": ".raw"})
    list(reader.pushFilters([GreaterThan(("frame_id",), 32)]))
    assert [r[1:] for p in reader.partitions() for r in p.ranges] == [(1, 1, False)]
    reader = raw_frames.FilteredRawFrameReader({"path": f"file://{tmp_path}", "framesamples": "2", "suffix": ".raw"})
    path = reader.partitions()[0].ranges[0][0]
    list(reader.pushFilters([EqualTo(("path",), path)]))
    assert [r[0] for p in reader.partitions() for r in p.ranges] == [path]


def test_frame_sizes():
    assert raw_frames.frame_samples("PAL", "CVBS_U10_4FSC") == 709379
    assert raw_frames.frame_samples("PAL", "RAW_S16_28M") == 1120000
    assert raw_frames.frame_samples("NTSC", "RAW_S16_40M") == 1334667


def test_sidecar_replaces_and_clears(spark, tmp_path):
    schema = sidecar.TABLES["dropout_run"]["schema"]
    base = str(tmp_path)
    sidecar.write_sidecar(spark.createDataFrame([(1, 0, 5, 5, 75), (2, 0, 5, 5, 75)], schema), base, "dropout_run")
    sidecar.write_sidecar(spark.createDataFrame([(1, 3, 1, 1, 25)], schema), base, "dropout_run", files=[1, 2])
    assert [tuple(r) for r in sidecar.read_sidecar(spark, base, "dropout_run").select("cvbs_file_id", "frame_id").collect()] == [(1, 3)]


def test_logs(spark, tmp_path):
    (tmp_path / "pal_threads-auto_run-2.log").write_text("x\nGenerating and writing 250 frame(s)\nusing 8 synthesis threads\nGenerating and writing 9 frames")
    (tmp_path / "pal_threads-1_run-1.log").write_text("nothing\n")
    rows = logs.read_run_logs(spark, str(tmp_path)).orderBy("run_no").collect()
    assert [(r.project, r.threads, r.frames, r.workers) for r in rows] == [("pal", "1", 0, 1), ("pal", "auto", 250, 8)]


def test_tokens_are_replaced_once(spark):
    df = spark.sql(
        "SELECT '{section_name}|{bogus}|{timecode} {open' text, '{timecode}' section_name, 5 picture_number, 1 phase_id, "
        "array(16777215, 10) words, 26 frame_number, 'PAL' standard, 'CLV' disc_type"
    )
    assert text.resolve_tokens(df).first().resolved == "{timecode}|{bogus}|00:00:01:00 {open"


@pytest.mark.parametrize("path,want", [
    ("{user}/a/../b.cvbs", "/home/u/b.cvbs"), ("{rel}/x", "/p/sub/x"), ("{project}", "/p"), ("{output}/y.cvbsy", "/p/y.cvbsy"),
    ("{nope}/z", "{nope}/z"), ("plain/./q", "/p/plain/q"), ("/abs//r", "/abs//r"), ("", ""),
])
def test_paths(spark, path, want):
    df = spark.createDataFrame([(path, "/p")], "path string, project_dir string")
    assert text.resolve_paths(df, {"user": "/home/u", "rel": "sub"}).first().resolved_path == want


def test_named_pairs_cover_all_pairs(spark):
    df = spark.createDataFrame([(9, 1, [1, 2]), (9, 2, [1, 2]), (9, 3, [1, 5])], "picture_number bigint, capture_id bigint, samples array<int>")
    star = compare.compare_captures(df).orderBy("capture_b").collect()
    assert [(r.capture_a, r.capture_b, r.identical) for r in star] == [(1, 2, True), (1, 3, False)]
    pairs = spark.createDataFrame([(2, 3)], "capture_a bigint, capture_b bigint")
    row = compare.compare_captures(df, pairs=pairs).first()
    assert (row.n_diff, row.first_diff, row.value_a, row.value_b) == (1, 1, 2, 5)


def test_repeated_frames_count_once_and_the_latest_counts(spark):
    rows = [(9, c, f, [1, 2, 3] if f < 3 or c == 1 else [1, 2, 4]) for c in (1, 2) for f in range(4)] + [(8, c, 0, None if c == 1 else [5]) for c in (1, 2)]
    df = spark.createDataFrame(rows, "picture_number bigint, capture_id bigint, frame_id bigint, samples array<int>")
    got = {r.picture_number: r for r in compare.compare_captures(df).collect()}
    assert len(got) == 2 == compare.compare_captures(df).count()
    assert (got[9].identical, got[9].n_diff, got[9].first_diff, got[9].value_a, got[9].value_b) == (False, 1, 2, 3, 4)
    assert got[8].identical is False


def test_digest_ignores_layout(spark):
    df = spark.range(1000).select("id", (F.col("id") * 3).alias("x"))
    assert compare.table_digest(df.repartition(7)).collect() == compare.table_digest(df.orderBy(F.desc("x"))).collect()


def test_digest_tells_nulls_and_borders_apart(spark):
    def digest(rows):
        return compare.table_digest(spark.createDataFrame(rows, "a string, b string"), method="sha2").collect()

    assert digest([("x", None)]) != digest([("x", "\\N")])
    assert digest([("a\x1fb", "c")]) != digest([("a", "b\x1fc")])
    assert digest([("a", "b"), (None, "c")]) == digest([(None, "c"), ("a", "b")])


@pytest.mark.parametrize("word,rule", [("0x81D234", None), ("zz", "hex.number"), ("0x1FFFFFF", "hex.bits"), ("0x88D000", "hex.x1"), ("0x81E000", "hex.d")])
def test_user_words(spark, word, rule):
    df = spark.createDataFrame([(1, 1, "users_code", word)], "project_id bigint, section_no int, code_type string, word_text string")
    assert [r.rule for r in rules.rule_hex_words(df).collect()] == ([rule] if rule else [])


def test_ordering_rules(spark):
    schema = "project_id bigint, section_no int, section_type string"
    good = spark.createDataFrame([(1, 1, "lead_in"), (1, 2, "programme_area"), (1, 3, "lead_out")], schema)
    assert rules.rule_ordering(good).count() == 0
    bad = spark.createDataFrame([(1, 1, "programme_area"), (1, 2, "lead_in"), (1, 3, None), (1, 4, "lead_out"), (1, 5, "lead_out"), (1, 6, "programme_area")], schema)
    assert sorted(r.rule for r in rules.rule_ordering(bad).collect()) == [
        "ordering.after_lead_out", "ordering.before_lead_in", "ordering.between", "ordering.one_lead_out",
    ]


def test_report_stops_at_the_first_failing_section(spark):
    found = spark.createDataFrame(
        [(1, 2, "r", "error", ""), (1, 3, "s", "error", ""), (1, 1, "w", "warning", ""), (2, 1, "w", "warning", "")],
        "project_id bigint, section_no int, rule string, severity string, detail string",
    )
    projects = spark.createDataFrame([(1,), (2,), (3,)], "project_id bigint")
    full = {r.project_id: r for r in rules.validation_report(projects, [found]).collect()}
    assert (full[1].n_errors, full[1].is_valid, full[2].is_valid, full[3].is_valid) == (2, False, True, True)
    first = {r.project_id: r for r in rules.validation_report(projects, [found], first_only=True).collect()}
    assert (first[1].n_errors, first[1].n_warnings, first[1].failed_rules) == (1, 1, "r")


def test_given_metadata_moves_the_dropouts(spark):
    df = spark.createDataFrame(
        [("a/b.cvbs", None), ("a/b.cvbsy", ""), ("a/b.cvbs", "m/x.meta"), ("a/b.raw", "m/x.db"), ("", "x.meta"), (None, "x.meta"), (None, None)],
        "p string, given string",
    )
    got = [(r.meta_path, r.dropouts_path) for r in text.companion_paths(df, "p", metadata="given").collect()]
    assert got == [
        ("a/b.meta", "a/b.dropouts.meta"), ("a/b.meta", "a/b.dropouts.meta"), ("m/x.meta", "m/x.dropouts.meta"),
        ("m/x.db", "m/x.db.dropouts.meta"), ("x.meta", "x.dropouts.meta"), ("x.meta", "x.dropouts.meta"), (None, None),
    ]
