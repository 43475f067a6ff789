"""Files of any size, commits of the raw frame writer, and equality that minds nulls."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framekit.operators import compare, samples, vbi
from framekit.sources import raw_frames


def tree(data, chunk, fan=1024, levels=3):
    rows = {i // chunk: hashlib.sha256(b"0:" + data[i : i + chunk]).hexdigest() for i in range(0, max(len(data), 1), chunk)}
    for _ in range(levels):
        up = {}
        for at in sorted(rows):
            up.setdefault(at // fan, []).append(rows[at])
        rows = {k: hashlib.sha256(("1:" + "".join(v)).encode()).hexdigest() for k, v in up.items()}
    return hashlib.sha256(("1:" + "".join(rows[k] for k in sorted(rows))).encode()).hexdigest()


def test_tree_digests_of_files_of_any_size(spark, tmp_path):
    texts = {"a.bin": b"abc", "b.bin": b"", "c.bin": bytes(range(256)) * 40}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in compare.manifest_of_files(spark, str(tmp_path), ".bin", chunk_bytes=100).collect()}
    assert {n: (r.digest, r.n_bytes) for n, r in got.items()} == {n: (tree(d, 100), len(d)) for n, d in texts.items()}
    with open(tmp_path / "big.sparse", "wb") as file:
        file.truncate(3 << 30)
    big = compare.manifest_of_files(spark, str(tmp_path), ".sparse", chunk_bytes=64 << 20).first()
    assert (big.n_bytes, big.n_chunks) == (3 << 30, 48)
    assert compare.manifest_of_files(spark, str(tmp_path), ".none").count() == 0


def frames_of(spark, rows):
    return spark.createDataFrame([(c, f, [f % 100 + i for i in range(4)]) for c, f in rows], "capture_id bigint, frame_id bigint, codes array<int>")


def test_gaps_stay_in_a_file_and_small_files_share_a_task(spark, tmp_path):
    rows = [(c, f) for c in (1, 2) for f in range(0, 1000, 3)]
    index = raw_frames.write_raw_frames(frames_of(spark, rows), str(tmp_path), per_file=100).collect()
    assert len(index) == 20 and all(r.gaps and r.n_frames in (33, 34) for r in index)
    back = raw_frames.read_raw_frames(spark, str(tmp_path), samples=4, suffix=".raw")
    assert back.rdd.getNumPartitions() == 1
    got = sorted((int(r.path.split("capture=")[1].split("-")[0]), r.frame_id, list(r.samples)) for r in back.collect())
    assert got == sorted((c, f, [f % 100 + i for i in range(4)]) for c, f in rows)
    raw_frames.write_raw_frames(frames_of(spark, [(3, f) for f in range(50)]), str(tmp_path), per_file=100)
    assert raw_frames.read_raw_frames(spark, str(tmp_path), samples=4, suffix=".raw").count() == len(rows) + 50


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    frames = frames_of(spark, [(1, f) for f in range(40)])
    broken = frames.withColumn("codes", F.when(F.col("frame_id") == 30, F.raise_error(F.lit("no"))).otherwise(F.col("codes")))
    with pytest.raises(Exception, match="no"):
        raw_frames.write_raw_frames(broken, str(tmp_path), per_file=10)
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")]
    (tmp_path / "capture=9-first=000000000000.raw").write_bytes(np.zeros(4, "<i2").tobytes())
    raw_frames.write_raw_frames(frames, str(tmp_path), per_file=10)
    assert raw_frames.read_raw_frames(spark, str(tmp_path), samples=4, suffix=".raw").count() == 40  # what was never committed is not read


def test_nulls_count_by_their_place(spark):
    rows = [(1, 1, [None, 5, 7]), (2, 1, [5, None, 7]), (3, 1, [None, 5, 7]), (4, 1, None), (5, 1, []), (6, 1, [])]
    frames = spark.createDataFrame(rows, "capture_id bigint, picture_number bigint, samples array<int>")
    got = {r.capture_b: (r.identical, r.n_diff) for r in compare.compare_captures(frames).collect()}
    assert got[2] == (False, 2) and got[3] == (True, 0) and not got[4][0] and not got[5][0]
    classes = {r.capture_id: (r.class_capture, r.n_captures) for r in compare.capture_classes(frames).collect()}
    assert classes == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    verdict = compare.pair_verdicts(compare.capture_classes(frames)).first()
    assert (verdict.n_pairs, verdict.n_identical, verdict.n_classes) == (15, 2, 4)
    for method in ("xxhash64", "sha2"):
        def digest(row, kind="a string, b string", method=method):
            return tuple(compare.table_digest(spark.createDataFrame([row], kind), method=method).first())
        assert digest((None, "x")) != digest(("x", None))
        assert digest(([None, "a"],), "a array<string>") != digest((["a", None],), "a array<string>")
        assert digest((["null"],), "a array<string>") != digest(([None],), "a array<string>")


def test_missing_numbers_are_ranges(spark):
    frames = spark.createDataFrame([(1, 0, 1), (1, 1, 1_000_000_000), (1, 2, None), (1, 3, None), (2, 0, 5), (2, 1, 8)], "capture_id bigint, frame_id bigint, picture_number bigint")
    assert sorted(map(tuple, vbi.number_gaps(frames).collect())) == [(1, 2, 999_999_999, 999_999_998), (2, 6, 7, 2)]
    assert vbi.frame_map(frames.filter("picture_number is null or capture_id = 2")).orderBy("capture_id", "picture_number").collect() == [
        (1, None, 3, 2, False), (2, 5, 0, 1, False), (2, 6, None, 0, True), (2, 7, None, 0, True), (2, 8, 1, 1, False)]


def test_statistics_work_a_row_out_once(spark):
    rows = spark.createDataFrame([(1, 0, [0.1, 0.5], [0.2, 0.4], [0.3, 0.3]), (1, 1, [], [], [])], "image_id int, y int, r array<double>, g array<double>, b array<double>")
    found = samples.component_stats(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "pow" in line.lower() for line in plan.splitlines())
    assert found.first().n == 2


def test_a_growing_file_gives_whole_frames_only(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    data = np.arange(12, dtype="<i2").tobytes()  # three frames of four samples
    seen = []
    for size in (0, 12, 12, 24):
        with open(folder / "capture=1.raw", "wb") as file:
            file.write(data[:size])
        stream = raw_frames.stream_raw_frames(spark, str(folder), samples=4, suffix=".raw")
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted((r.frame_id, list(r.samples)) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()))
    frames = [(i, [4 * i + j for j in range(4)]) for i in range(3)]
    assert seen == [[], frames[:1], frames[:1], frames]
