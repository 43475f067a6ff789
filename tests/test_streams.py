"""Streams of several captures: nothing of a capture that starts later may be lost."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framekit.sources import sidecar
from framekit.streaming import streams as st

SCHEMA = "capture_id bigint, started timestamp, frame_id bigint, picture_number bigint, sample_count bigint"


def batches(spark, tmp_path, groups):
    """A stream that reads one group of rows per batch."""
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        newest = max((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        import os
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def captures(late_start=timedelta(hours=1)):
    day = datetime(2024, 5, 1)
    first = [(1, day, i, i + 1, 10) for i in range(15000, 16000)]
    second = [(2, day + late_start, i, i + 1, 10) for i in range(1000)]
    end = [(st.NO_CAPTURE, day + timedelta(days=2), 0, 0, 0)]
    return [first[:500], first[500:], second[:500], second[500:] + end]


def test_second_capture_starts_late_and_keeps_all_rows(spark, tmp_path):
    frames = batches(spark, tmp_path, captures())
    steps = st.run_to_table(st.stream_continuity(frames, 25.0, "60 seconds"), "steps").filter("capture_id >= 0")
    counts = {(r.capture_id, r.step_class): r["count"] for r in steps.groupBy("capture_id", "step_class").count().collect()}
    assert counts == {(1, "lost_predecessor"): 1, (1, "contiguous"): 999, (2, "start"): 1, (2, "contiguous"): 999}
    rate = st.run_to_table(st.stream_dropout_rate(frames, 25.0, "10 seconds"), "rate").filter("capture_id >= 0")
    assert {r.capture_id: r.n for r in rate.groupBy("capture_id").agg(F.sum("n_runs").alias("n")).collect()} == {1: 1000, 2: 1000}
    bursts = st.run_to_table(st.stream_dropout_bursts(frames, 25.0, "2 seconds"), "bursts").filter("capture_id >= 0")
    assert sorted((r.capture_id, r.n_runs) for r in bursts.collect()) == [(1, 1000), (2, 1000)]


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    frames = batches(spark, tmp_path, captures(timedelta(hours=-1)))
    with pytest.raises(ValueError, match="after the watermark"):
        st.run_to_table(st.stream_dropout_rate(frames, 25.0, "10 seconds"), "late")


def test_late_rows_of_all_batches_are_counted(spark, tmp_path):
    """A late row in the first of more batches than a query keeps progress of."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        day = datetime(2024, 5, 1)
        groups = [[(1, day, 15000, 1, 1)], [(1, day, 16000, 1, 1)], [(2, day, 0, 1, 1)], *([(1, day, 16001 + i, 1, 1)] for i in range(6))]
        with pytest.raises(ValueError, match="1 rows came after"):
            st.run_to_table(st.stream_dropout_rate(batches(spark, tmp_path, groups), 25.0, "10 seconds"), "late")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_state_tells_steps_of_shuffled_batches_gaps_and_replays(spark, tmp_path):
    import random

    day = datetime(2024, 5, 1)
    rows = [(c, day, f, f + 1 + f // 9, 1) for c in (1, 2) for f in range(200) if f not in (77, 78, 128)]
    random.Random(3).shuffle(rows)
    groups = [rows[i::4] for i in range(4)]
    groups[3] = [*groups[3], next(r for r in groups[0] if r[2] == max(x[2] for x in groups[0]))]
    groups.append([(st.NO_CAPTURE, day + timedelta(days=9), 0, 0, 0)])
    got = st.run_to_table(st.stream_continuity_stateful(batches(spark, tmp_path, groups), 25.0, "1 day", block=16), "state").filter("capture_id >= 0").collect()
    numbers = {(c, f): p for c, _, f, p, _ in rows}
    want = []
    for (c, f), p in numbers.items():
        before = numbers.get((c, f - 1))
        step = None if before is None else p - before
        kind = "start" if f == 0 else "lost_predecessor" if before is None else "contiguous" if step == 1 else "forward_gap"
        want.append((c, f, p, before, kind, max(0, (step or 1) - 1)))
    replays = [r for r in got if r.step_class == "replay"]
    assert sorted((r.capture_id, r.frame_id, r.picture_number, r.previous or -1, r.step_class, r.missing) for r in got if r.step_class != "replay") == sorted(
        (c, f, p, b or -1, k, m) for c, f, p, b, k, m in want)
    assert len(replays) == 1 and replays[0].picture_number == replays[0].previous


def test_a_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    schema = "cvbs_file_id bigint, frame_id bigint, sample_start bigint, sample_count bigint, severity int"
    for i, rows in enumerate(([(1, 0, 5, 9, 25), (1, 1, 5, 9, 25)], [(1, 2, 5, 9, 25)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{i}")
        st.ingest_sidecar(stream, f"{tmp_path}/out", f"{tmp_path}/check{i}").awaitTermination()
    assert sorted(r.frame_id for r in sidecar.read_sidecar(spark, f"{tmp_path}/out", "dropout_run").collect()) == [0, 1, 2]


def test_ingestion_merges_copies_however_far_apart(spark, tmp_path):
    schema = "cvbs_file_id bigint, frame_id bigint, sample_start bigint, sample_count bigint, severity int"
    rows = [(1, 0, 5, 9, 25), (1, 1, 5, 9, 25), (2, 0, 5, 9, 75)]
    for i, part in enumerate((rows, [(1, 0, 5, 9, 75), (3, 0, 1, 1, 25)], rows)):
        import os
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        newest = max((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    st.ingest_sidecar(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.cvbs_file_id, r.frame_id, r.severity) for r in sidecar.read_sidecar(spark, f"{tmp_path}/out", "dropout_run").collect())
    assert got == [(1, 0, 75), (1, 1, 25), (2, 0, 75), (3, 0, 25)]


def test_state_keeps_captures_however_far_apart(spark, tmp_path):
    """Captures start an hour apart by their number: 90,000 of them span ten years, and each batch holds rows of all of them."""
    import duckdb

    from framekit.plans import catalog
    from framekit.plans.fixtures import table

    users = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in (0, 7, 45000, 90000))), (F.col("event_id") % 4 + 1).cast("int"))
    table(spark, "/root/testdata/sf0.001", "events").limit(200).withColumn("user_id", users).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["stream_continuity_stateful"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["stream_continuity_stateful"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and len(got) == 200


def test_ingestion_of_many_files_makes_few_folders(spark, tmp_path):
    """One folder per file took most of the time: 3,000 files lie in three folders, and a later batch leaves the other files of its folder alone."""
    schema = "cvbs_file_id bigint, frame_id bigint, sample_start bigint, sample_count bigint, severity int"
    first = spark.range(3000).selectExpr("id cvbs_file_id", "0L frame_id", "5L sample_start", "9L sample_count", "25 severity")
    second = spark.createDataFrame([(7, 0, 5, 9, 75), (7, 1, 5, 9, 25), (None, 0, 5, 9, 25)], schema)
    for i, rows in enumerate((first, second, second)):
        rows.write.parquet(f"{tmp_path}/in{i}")
        st.ingest_sidecar(spark.readStream.schema(schema).parquet(f"{tmp_path}/in{i}"), f"{tmp_path}/out", f"{tmp_path}/check{i}").awaitTermination()
    assert len([p for p in (tmp_path / "out" / "dropout_run").iterdir() if p.is_dir()]) == 4
    got = sidecar.read_sidecar(spark, f"{tmp_path}/out", "dropout_run")
    assert got.count() == 3002 and got.select("cvbs_file_id").distinct().count() == 3001
    some = sorted((r.frame_id, r.severity) for r in got.filter("cvbs_file_id = 7").collect())
    assert some == [(0, 75), (1, 25)] and got.filter("cvbs_file_id is null").count() == 1
    assert sidecar.read_sidecar(spark, f"{tmp_path}/out", "dropout_run", second).count() == 3
