"""Operators on dropout runs: half-open sample ranges per (capture, frame).

A frame has at most 709,379 samples. Runs are first reduced to one row per (keys, start), so a window
over one frame never sees more rows than that, however many copies of a run there are. Range joins go
by position buckets of the frame, which also spreads a frame that holds most of the runs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framekit.dims import by_standard
from framekit.functions.clocks import idiv

FRAME = ["capture_id", "frame_id"]
BUCKET = 4096
SEVERITY_VISIBLE, SEVERITY_HIDDEN = 75, 25


def _end() -> Column:
    return F.col("sample_start") + F.col("sample_count")


def merge_intervals(runs: DataFrame, keys: Sequence[str] = FRAME, attrs: Sequence[str] = ("run_id",)) -> DataFrame:
    """Merge overlapping or touching runs; ``attrs`` come from the run with the lowest (start, attrs)."""
    starts = runs.groupBy(*keys, "sample_start").agg(
        F.max(_end()).alias("__end"), F.min(F.struct(*attrs)).alias("__attrs")
    )
    order = Window.partitionBy(*keys).orderBy("sample_start")
    reach = F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn("__new", (reach.isNull() | (F.col("sample_start") > reach)).cast("int"))
    islands = opened.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        islands.groupBy(*keys, "__island")
        .agg(
            F.min("sample_start").alias("sample_start"),
            F.max("__end").alias("__end"),
            F.min(F.when(F.col("__new") == 1, F.col("__attrs"))).alias("__attrs"),
        )
        .select(*keys, "sample_start", (F.col("__end") - F.col("sample_start")).alias("sample_count"), "__attrs.*")
    )


def _buckets(lo: Column, hi: Column) -> Column:
    return F.sequence(idiv(lo, BUCKET), idiv(hi - 1, BUCKET))


def _islands(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged runs as (keys, b_lo, b_hi), once per bucket that they touch."""
    return merge_intervals(runs.withColumn("__one", F.lit(0)), keys, ["__one"]).select(
        *keys, F.col("sample_start").alias("b_lo"), _end().alias("b_hi")
    ).withColumn("__bucket", F.explode(_buckets(F.col("b_lo"), F.col("b_hi"))))


def _first_meeting(lo: Column, b_lo: Column) -> Column:
    """True in one bucket only: the first one that both ranges touch."""
    return F.col("__bucket") == idiv(F.greatest(lo, b_lo), BUCKET)


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join runs to the islands that they overlap, each pair once."""
    left = a.withColumn("__bucket", F.explode(_buckets(F.col("sample_start"), _end()))).alias("a")
    right = _islands(b, keys).alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [
        F.col("a.__bucket") == F.col("b.__bucket"),
        F.col("b.b_lo") < F.col("a.sample_start") + F.col("a.sample_count"),
        F.col("b.b_hi") > F.col("a.sample_start"),
        F.col("a.__bucket") == idiv(F.greatest(F.col("a.sample_start"), F.col("b.b_lo")), BUCKET),
    ]
    return left.join(right, cond, how).select(
        *[F.col(f"a.{c}").alias(c) for c in a.columns], F.col("b.b_lo"), F.col("b.b_hi")
    )


def subtract_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """The parts of each run of ``a`` outside every run of ``b`` in the same frame; ``a`` has a unique ``run_id``.

    The islands of ``b`` within one run are disjoint, so the list per run is bounded by the run's length.
    """
    pairs = _meet(a, b, keys, "left")
    cut = F.array_sort(F.collect_list(F.when(F.col("b_lo").isNotNull(), F.struct("b_lo", "b_hi"))))
    own = pairs.groupBy(*a.columns).agg(cut.alias("__cut"))
    lows = F.concat(F.array(F.col("sample_start")), F.transform("__cut", lambda c: c["b_hi"]))
    highs = F.concat(F.transform("__cut", lambda c: c["b_lo"]), F.array(_end()))
    parts = F.filter(
        F.zip_with(lows, highs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), lambda p: p["lo"] < p["hi"]
    )
    rest = [c for c in a.columns if c not in ("sample_start", "sample_count")]
    return own.select(*rest, F.explode(parts).alias("__p")).select(
        *rest, F.col("__p.lo").alias("sample_start"), (F.col("__p.hi") - F.col("__p.lo")).alias("sample_count")
    )


def clip_random_runs(random: DataFrame, scratch: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Random runs without the scratched ranges, then merged."""
    return merge_intervals(subtract_intervals(random, scratch, keys), keys)


def split_at_boundaries(runs: DataFrame, standard: str | Column = "standard") -> DataFrame:
    """D3: cut runs at the edges of the active picture; severity 75 inside and 25 outside."""
    lo, hi = by_standard("active_start", standard), by_standard("active_end", standard) + 1
    start, end = F.col("sample_start"), _end()

    def piece(a: Column, b: Column, severity: int) -> Column:
        return F.struct(a.cast("bigint").alias("s"), (b - a).cast("bigint").alias("n"), F.lit(severity).alias("sev"))

    pieces = F.array(
        piece(start, F.least(end, lo), SEVERITY_HIDDEN),
        piece(F.greatest(start, lo), F.least(end, hi), SEVERITY_VISIBLE),
        piece(F.greatest(start, hi), end, SEVERITY_HIDDEN),
    )
    rest = [c for c in runs.columns if c not in ("sample_start", "sample_count")]
    return runs.select(*rest, F.explode(F.filter(pieces, lambda p: p["n"] > 0)).alias("__p")).select(
        *rest, F.col("__p.s").alias("sample_start"), F.col("__p.n").alias("sample_count"), F.col("__p.sev").alias("severity")
    )


def line_of_sample(sample: Column, standard: str | Column = "standard") -> Column:
    """1-based line that holds a sample; lines 313 and 625 of PAL are two samples longer."""
    std = F.col(standard) if isinstance(standard, str) else standard
    spl = by_standard("samples_per_line", std)
    late = (std == "PAL") & (sample >= 313 * 1135 + 2)
    edge = (std == "PAL") & (sample >= 313 * 1135) & (sample < 313 * 1135 + 2)
    line = F.when(edge, 312).otherwise(idiv(F.when(late, sample - 2).otherwise(sample), spl))
    return F.least(line, (by_standard("lines", std) - 1).cast("bigint")).cast("int") + 1


def offset_of_line(line: Column, standard: str | Column = "standard") -> Column:
    std = F.col(standard) if isinstance(standard, str) else standard
    shift = F.when((std == "PAL") & (line > 313), 2).otherwise(0)
    after = F.when((std == "PAL") & (line > 625), 2).otherwise(0)
    return ((line - 1) * by_standard("samples_per_line", std) + shift + after).cast("bigint")


def outside_frame(runs: DataFrame, frame_samples: int | Column) -> DataFrame:
    """Runs that reach beyond their frame, with the samples that lie outside (``before``, ``after``); line and stack operators leave these out."""
    spf = F.lit(frame_samples) if isinstance(frame_samples, int) else frame_samples
    none = F.lit(0).cast("bigint")
    before = F.least(F.greatest(-F.col("sample_start"), none), F.col("sample_count"))
    after = F.least(F.greatest(_end() - spf, none), F.col("sample_count"))
    return runs.select("*", before.alias("before"), after.alias("after")).filter((before > 0) | (after > 0))


def runs_to_lines(runs: DataFrame, standard: str | Column = "standard") -> DataFrame:
    """One row per line that a run touches, with the piece's start in the line and its length."""
    lines = runs.withColumn(
        "line_no",
        F.explode(F.sequence(line_of_sample(F.col("sample_start"), standard), line_of_sample(_end() - 1, standard))),
    )
    lo = offset_of_line(F.col("line_no"), standard)
    hi = offset_of_line(F.col("line_no") + 1, standard)
    start = F.greatest(F.col("sample_start"), lo)
    return lines.select(
        *[c for c in runs.columns if c not in ("sample_start", "sample_count")], "line_no",
        (start - lo).alias("line_start"), (F.least(_end(), hi) - start).alias("line_count"),
    )


def dropout_coverage(runs: DataFrame, frame_samples: int | Column, group: str = "capture_id") -> DataFrame:
    """Runs, lost samples and share of the frame per frame, per ``group`` and in all (``level`` 0, 1, 3).

    ``runs`` are merged runs with a severity. One row per frame is made first, then rolled up.
    """
    spf = F.lit(frame_samples) if isinstance(frame_samples, int) else frame_samples
    lost = F.col("sample_count")
    frames = runs.groupBy(group, "frame_id").agg(
        F.count("*").alias("n_runs"), F.sum(lost).alias("lost"),
        F.sum(F.when(F.col("severity") == SEVERITY_VISIBLE, lost).otherwise(0)).alias("lost_visible"),
        F.max(spf).cast("bigint").alias("frame_samples"),
    )
    return frames.rollup(group, "frame_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n_frames"), F.sum("n_runs").alias("n_runs"), F.sum("lost").alias("lost"),
        F.sum("lost_visible").alias("lost_visible"),
        F.round(F.sum("lost") * 100.0 / F.sum("frame_samples"), 6).alias("lost_percent"),
    )


def scratch_lifespan(events: DataFrame, frame_samples: int | Column) -> DataFrame:
    """The runs of long scratches: width and push rise and fall linearly over ``duration_frames``.

    ``events``: peak_width, max_push, duration_frames, anchor_sample. ``frame_index`` counts in the section.
    """
    spf = F.lit(frame_samples) if isinstance(frame_samples, int) else frame_samples
    last = F.col("duration_frames") - 1
    rows = events.withColumn("frame_index", F.explode(F.sequence(F.lit(0), last)))
    progress = F.when(last > 0, F.col("frame_index").cast("double") / last).otherwise(1.0)
    triangle = F.lit(1.0) - F.abs(progress * 2.0 - 1.0)
    width = F.round(F.col("peak_width") * triangle).cast("bigint")
    start = F.least(F.greatest(F.col("anchor_sample"), F.lit(0).cast("bigint")), spf - width)
    return rows.filter(width > 0).select(
        *[c for c in rows.columns if c not in ("peak_width", "max_push", "anchor_sample", "duration_frames")],
        start.cast("bigint").alias("sample_start"), width.alias("sample_count"),
        (F.col("max_push") * triangle).alias("push"),
    )


def score_detections(truth: DataFrame, found: DataFrame, by: str = "capture_id") -> DataFrame:
    """Matched, missed and false runs, and sample-level precision, recall and IoU, per capture.

    One sweep per frame over the starts and ends of both sides: running sums tell which sides cover each stretch, and how many samples the
    other side has covered so far; a run is hit if that grows between its two ends. No run meets another one, so overlaps of any depth
    cost nothing more; the runs are shuffled once, by frame.
    """
    keys = [by, "frame_id"]

    def ends(runs: DataFrame, is_truth: bool) -> DataFrame:
        at = F.array(
            F.struct(F.col("sample_start").cast("bigint").alias("pos"), F.lit(1).alias("step")),
            F.struct(_end().cast("bigint").alias("pos"), F.lit(-1).alias("step")),
        )
        return runs.select(*keys, F.lit(is_truth).alias("is_truth"), "run_id", F.inline(at))

    def covered(side: Column) -> Column:
        return F.when(F.sum(F.when(side, F.col("step")).otherwise(0)).over(order) > 0, F.col("len")).otherwise(0)

    order = Window.partitionBy(*keys).orderBy("pos")
    is_truth = F.col("is_truth")
    swept = ends(truth, True).unionByName(ends(found, False)).withColumn("len", F.coalesce(F.lead("pos").over(order) - F.col("pos"), F.lit(0)))
    swept = swept.withColumns({"t": covered(is_truth), "f": covered(~is_truth)})
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    other = F.coalesce(F.when(is_truth, F.sum("f").over(before)).otherwise(F.sum("t").over(before)), F.lit(0))
    both = F.when((F.col("t") > 0) & (F.col("f") > 0), F.col("len")).otherwise(0)
    runs = swept.select(*keys, "is_truth", "run_id", "t", "f", both.alias("both"), other.alias("other")).groupBy(*keys, "is_truth", "run_id").agg(
        (F.max("other") > F.min("other")).alias("hit"), *(F.sum(c).alias(c) for c in ("t", "f", "both")),
    )

    def ratio(a: str, b: Column) -> Column:
        return F.round(F.when(b > 0, F.col(a).cast("double") / b), 6)

    summed = runs.groupBy(by).agg(
        *(F.sum(c).alias(c) for c in ("t", "f", "both")), F.count_if(is_truth & F.col("hit")).alias("matched"),
        F.count_if(is_truth & ~F.col("hit")).alias("missed"), F.count_if(~is_truth & ~F.col("hit")).alias("false_runs"),
    )
    return summed.select(
        by, "matched", "missed", "false_runs", ratio("both", F.col("f")).alias("precision"), ratio("both", F.col("t")).alias("recall"),
        ratio("both", F.col("t") + F.col("f") - F.col("both")).alias("iou"),
    )


def stack_coverage(
    runs: DataFrame, aligned: DataFrame, frame_samples: int, k: int, key: str = "picture_number"
) -> DataFrame:
    """Sample ranges of each picture that at least ``k`` sources show without a dropout.

    ``aligned``: (capture_id, frame_id, picture_number). Sources' runs are merged first; the +1/-1 steps
    are summed per position before the window, so a picture has at most one row per sample. Runs are clipped to
    the frame at both ends; ``outside_frame`` lists those that reach beyond it.
    """
    within = runs.withColumns({
        "sample_start": F.greatest(F.col("sample_start"), F.lit(0).cast("bigint")),
        "sample_count": F.least(_end(), F.lit(frame_samples)) - F.greatest(F.col("sample_start"), F.lit(0).cast("bigint")),
    }).filter("sample_count > 0")
    merged = merge_intervals(within).join(aligned.select(*FRAME, key), FRAME)
    steps = merged.select(
        key,
        F.explode(F.array(
            F.struct(F.col("sample_start").alias("at"), F.lit(1).alias("d")),
            F.struct(F.least(_end(), F.lit(frame_samples)).alias("at"), F.lit(-1).alias("d")),
        )).alias("e"),
    ).select(key, F.col("e.at").alias("at"), F.col("e.d").alias("d"))
    sources = aligned.groupBy(key).agg(F.count("*").alias("n_sources"))
    edges = sources.select(
        key, F.explode(F.array(F.lit(0), F.lit(frame_samples)).cast("array<bigint>")).alias("at"), F.lit(0).alias("d")
    )
    order = Window.partitionBy(key).orderBy("at")
    swept = (
        steps.unionByName(edges).groupBy(key, "at").agg(F.sum("d").alias("d"))
        .select(
            key, F.col("at").alias("range_start"), F.lead("at").over(order).alias("range_end"),
            F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bad"),
        )
        .filter(F.col("range_end").isNotNull())
    )
    return swept.join(sources, key).select(
        key, "range_start", "range_end", (F.col("n_sources") - F.col("bad")).alias("clean_sources")
    ).filter(F.col("clean_sources") >= k)


def dropout_params(sections: DataFrame, scale: str = "dropout_scale") -> DataFrame:
    """Event rates, durations and widths from a scale of 1..20 (exponential in the scale)."""
    t = (F.col(scale) - 1) / 19.0

    def grow(base: float, ratio: float) -> Column:
        return F.lit(base) * F.pow(F.lit(ratio), t)

    def whole(x: Column, least: int) -> Column:
        return F.greatest(F.round(x).cast("int"), F.lit(least))

    low = whole(grow(5.0, 10.0), 1)
    return sections.select(
        *sections.columns,
        grow(0.5, 400.0).alias("frequency"),
        low.alias("min_duration"),
        F.greatest(F.round(grow(50.0, 8.0)).cast("int"), low + 1).alias("max_duration"),
        whole(grow(2.0, 20.0), 2).alias("scratch_count"),
        whole(grow(2.0, 250.0), 1).alias("scratch_frames"),
        whole(grow(5.0, 400.0), 1).alias("scratch_width"),
    )


def apply_runs_to_samples(
    samples: DataFrame, runs: DataFrame, signal_range: float, clamp: tuple[float, float], keys: Sequence[str] = FRAME
) -> DataFrame:
    """Shift samples by the runs over them: push x range x direction x Tukey window (half tapered), clamped.

    Runs are expanded to their samples and summed per position, then joined on position: no range join.
    """
    n = F.col("sample_count").cast("double")
    x = F.col("__i") + 0.5
    ramp = n * 0.25
    taper = F.when(x < ramp, (1.0 - F.cos(math.pi * x / ramp)) * 0.5).when(
        x > n - ramp, (1.0 - F.cos(math.pi * (n - x) / ramp)) * 0.5
    ).otherwise(1.0)
    shifts = (
        runs.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sample_count") - 1)))
        .select(
            *keys, (F.col("sample_start") + F.col("__i")).cast("int").alias("pos"),
            (F.col("push") * signal_range * F.col("direction") * taper).alias("__shift"),
        )
        .groupBy(*keys, "pos").agg(F.sum("__shift").alias("__shift"))
    )
    moved = F.col("mv") + F.coalesce(F.col("__shift"), F.lit(0.0))
    return samples.join(shifts, [*keys, "pos"], "left").select(
        *[c for c in samples.columns if c != "mv"],
        F.when(F.col("__shift").isNull(), F.col("mv"))
        .otherwise(F.greatest(F.least(moved, F.lit(clamp[1])), F.lit(clamp[0]))).alias("mv"),
    )
