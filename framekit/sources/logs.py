"""Frame and thread counts from run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The log lines that hold the counts.
FRAMES_LINE = r"Generating and writing ([0-9]+) frame"
THREADS_LINE = r"using ([0-9]+) synthesis threads"


def _first(text: Column, pattern: str, missing: int) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit.cast("int")).otherwise(missing)


def parse_run_logs(logs: DataFrame, text: str = "text") -> DataFrame:
    """First stated frame count (0 if none) and thread count (1 if none) of each log text."""
    return logs.select(
        *[c for c in logs.columns if c != text],
        _first(F.col(text), FRAMES_LINE, 0).alias("frames"), _first(F.col(text), THREADS_LINE, 1).alias("workers"),
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs below ``path``, one row per file, with project, threads and run number from the file name."""
    logs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    name = F.regexp_extract("path", r"([^/]*)\.log$", 1)
    pattern = r"^(.*)_threads-([^_]*)_run-([0-9]+)$"
    return parse_run_logs(logs).select(
        F.regexp_extract(name, pattern, 1).alias("project"), F.regexp_extract(name, pattern, 2).alias("threads"),
        F.regexp_extract(name, pattern, 3).cast("int").alias("run_no"), "path", "frames", "workers",
    )
