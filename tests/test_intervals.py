import random

from pyspark.sql import functions as F

from framekit.operators import intervals as iv

RUN = "capture_id bigint, frame_id bigint, run_id bigint, sample_start bigint, sample_count bigint"


def random_runs(seed, n, span):
    rng = random.Random(seed)
    return [(rng.randint(0, 1), 0 if rng.random() < 0.8 else rng.randint(1, 3), i, rng.randint(0, span), rng.randint(1, 60)) for i in range(n)]


def covered(rows):
    out = {}
    for c, f, _, s, n in rows:
        out.setdefault((c, f), set()).update(range(s, s + n))
    return out


def stretches(points):
    out = []
    for p in sorted(points):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def test_merge_equals_enumeration(spark):
    rows = random_runs(1, 400, 12000)
    got = iv.merge_intervals(spark.createDataFrame(rows, RUN))
    want = {(k, a, b - a) for k, pts in covered(rows).items() for a, b in stretches(pts)}
    assert {((r.capture_id, r.frame_id), r.sample_start, r.sample_count) for r in got.collect()} == want


def test_merge_takes_attributes_of_the_lowest_start(spark):
    rows = [(1, 1, 5, 10, 10), (1, 1, 2, 15, 30), (1, 1, 9, 45, 1), (1, 1, 1, 47, 1)]
    got = sorted((r.sample_start, r.sample_count, r.run_id) for r in iv.merge_intervals(spark.createDataFrame(rows, RUN)).collect())
    assert got == [(10, 36, 5), (47, 1, 1)]


def test_subtract_equals_enumeration_across_buckets(spark):
    a, b = random_runs(2, 150, 9000), random_runs(3, 150, 9000)
    a.append((0, 0, 9999, 100, 8800))
    got = iv.subtract_intervals(spark.createDataFrame(a, RUN), spark.createDataFrame(b, RUN))
    bad = covered(b)
    want = set()
    for c, f, i, s, n in a:
        for lo, hi in stretches(set(range(s, s + n)) - bad.get((c, f), set())):
            want.add((i, lo, hi - lo))
    assert {(r.run_id, r.sample_start, r.sample_count) for r in got.collect()} == want


def test_split_cuts_at_both_edges(spark):
    rows = [(1, 1, 1, 24960, 20), (1, 1, 2, 0, 709379), (1, 1, 3, 707104, 1)]
    got = iv.split_at_boundaries(spark.createDataFrame(rows, RUN), F.lit("PAL"))
    assert sorted((r.run_id, r.sample_start, r.sample_count, r.severity) for r in got.collect()) == [
        (1, 24960, 10, 25), (1, 24970, 10, 75), (2, 0, 24970, 25), (2, 24970, 682135, 75), (2, 707105, 2274, 25), (3, 707104, 1, 75),
    ]


def test_scale_goldens(spark):
    df = spark.createDataFrame([(1,), (20,)], "dropout_scale int")
    got = [tuple(r) for r in iv.dropout_params(df).orderBy("dropout_scale").collect()]
    assert got[0][:4] == (1, 0.5, 5, 50) and got[0][4:] == (2, 2, 5)
    assert (got[1][0], round(got[1][1], 6)) == (20, 200.0) and got[1][2:] == (50, 400, 40, 500, 2000)


def test_stack_clips_runs_to_the_frame(spark):
    runs = spark.createDataFrame([(1, 0, 1, 950, 40), (1, 0, 2, 10, 5), (2, 0, 3, -5, 10)], RUN)
    aligned = spark.createDataFrame([(1, 0, 7), (2, 0, 7)], "capture_id bigint, frame_id bigint, picture_number bigint")
    got = sorted((r.range_start, r.range_end, r.clean_sources) for r in iv.stack_coverage(runs, aligned, 900, 1).collect())
    assert got == [(0, 5, 1), (5, 10, 2), (10, 15, 1), (15, 900, 2)]
    assert sorted((r.run_id, r.before, r.after) for r in iv.outside_frame(runs, 900).collect()) == [(1, 0, 40), (3, 5, 0)]


def test_clipped_random_runs_miss_every_scratch(spark):
    a, b = random_runs(5, 100, 3000), random_runs(6, 60, 3000)
    got = iv.clip_random_runs(spark.createDataFrame(a, RUN), spark.createDataFrame(b, RUN)).collect()
    bad = covered(b)
    for r in got:
        assert not bad.get((r.capture_id, r.frame_id), set()) & set(range(r.sample_start, r.sample_start + r.sample_count))


def test_lines_of_pal_frame(spark):
    rows = [(1, 1, 1, 313 * 1135 - 1, 5), (1, 1, 2, 709376, 3)]
    got = iv.runs_to_lines(spark.createDataFrame(rows, RUN), F.lit("PAL"))
    assert sorted((r.run_id, r.line_no, r.line_start, r.line_count) for r in got.collect()) == [
        (1, 313, 1134, 3), (1, 314, 0, 2), (2, 625, 1134, 3),
    ]
