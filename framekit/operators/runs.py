"""Run logs, suites and sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekit.dims import STANDARDS, by_standard
from framekit.sources.raw_frames import RAW_RATES, frame_samples


def best_of_runs(runs: DataFrame, keys: Sequence[str] = ("project", "threads")) -> DataFrame:
    """B1: fastest time per configuration; frames and workers are those of the last run."""
    best = runs.groupBy(*keys).agg(
        F.max_by("workers", "run_no").alias("workers"), F.max_by("frames", "run_no").alias("frames"),
        F.min("seconds").alias("seconds"),
    )
    rate = F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0)
    return best.withColumn("frames_per_second", F.round(rate, 2))


def append_results(results: DataFrame, path: str) -> None:
    """B1: append the results to a folder of CSV files with a header."""
    results.select("project", "threads", "workers", "frames", "seconds", "frames_per_second").write.mode("append").option(
        "header", "true"
    ).csv(path)


def suite_results(results: DataFrame, suite: str = "suite") -> DataFrame:
    """B2: failures of all projects per suite, from rows (suite, project, ok)."""
    failed = F.count(F.when(~F.col("ok"), 1))
    return results.groupBy(suite).agg(
        F.count("*").alias("n_projects"), failed.alias("n_failed"),
        F.when(failed > 0, "FAIL").otherwise("PASS").alias("verdict"),
    )


def size_estimate(projects: DataFrame) -> DataFrame:
    """Output bytes: two bytes per sample (twice for yc) and six per audio sample and channel pair.

    ``projects``: standard, encoding, signal_type, n_frames, audio_samples, n_pairs. RAW encodings have frames of another size.
    """
    planes = F.when(F.col("signal_type") == "yc", 2).otherwise(1)
    frame = by_standard("samples_per_frame").cast("bigint")
    for encoding in RAW_RATES:
        for standard in STANDARDS:
            frame = F.when((F.col("encoding") == encoding) & (F.col("standard") == standard), frame_samples(standard, encoding)).otherwise(frame)
    video = F.col("n_frames") * frame * 2 * planes
    audio = F.col("audio_samples") * 6 * F.col("n_pairs")
    return projects.select(
        *projects.columns, video.alias("video_bytes"), audio.cast("bigint").alias("audio_bytes"),
        (video + audio).cast("bigint").alias("total_bytes"),
    )


def size_totals(sized: DataFrame) -> DataFrame:
    """Totals for every combination of standard and signal type."""
    return sized.cube("standard", "signal_type").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_projects"),
        F.sum("total_bytes").alias("total_bytes"),
    )
