"""Sidecar tables as Parquet by stretches of files, and their constraints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.dims import by_standard
from framekit.operators.rules import DOMAINS
from framekit.session import exists, remove, scratch_dir

KEY = "cvbs_file_id"
#: A folder of a table holds a stretch of file numbers, so that there are few folders however many files there are.
GROUP = "file_group"
FILES_PER_FOLDER = {"cvbs_file": 65536, "audio_channel_pair": 8192, "dropout_run": 1024, "efm_frame": 16}
# Columns and primary keys of the four sidecar tables.
TABLES: dict[str, dict[str, str]] = {
    "cvbs_file": {
        "schema": "cvbs_file_id bigint, preset string, sample_encoding_preset string, signal_state_preset string, "
        "sequence_continuous boolean, signal_type string, decoder string, git_branch string, git_commit string, "
        "number_of_sequential_frames bigint, black_level int, has_nonstandard_values boolean, capture_notes string",
        "pk": "cvbs_file_id",
    },
    "audio_channel_pair": {"schema": "cvbs_file_id bigint, channel_pair int, description string", "pk": "cvbs_file_id,channel_pair"},
    "dropout_run": {
        "schema": "cvbs_file_id bigint, frame_id bigint, sample_start bigint, sample_count bigint, severity int",
        "pk": "cvbs_file_id,frame_id,sample_start",
    },
    "efm_frame": {
        "schema": "cvbs_file_id bigint, frame_id bigint, t_value_offset bigint, t_value_count bigint", "pk": "cvbs_file_id,frame_id",
    },
}
_NOT_NULL = {
    "cvbs_file": ["preset", "sample_encoding_preset", "signal_state_preset", "signal_type", "decoder"],
    "audio_channel_pair": ["channel_pair"],
    "dropout_run": ["cvbs_file_id", "frame_id", "sample_start", "sample_count", "severity"],
    "efm_frame": ["cvbs_file_id", "frame_id", "t_value_offset", "t_value_count"],
}
# Signal states that a file may record.
SIGNAL_STATES = [
    "STANDARD_STABLE_LOCKED", "STANDARD_STABLE_UNLOCKED", "STANDARD_RAW",
    "NONSTANDARD_STABLE_LOCKED", "NONSTANDARD_STABLE_UNLOCKED", "NONSTANDARD_RAW",
]


def checks(table: str) -> dict[str, Column]:
    """Conditions that valid rows meet; null passes, as in SQL."""
    c = F.col
    return {
        "cvbs_file": {
            "preset": c("preset").isin(*DOMAINS["standard"]),
            "sample_encoding_preset": c("sample_encoding_preset").isin(*DOMAINS["encoding"]),
            "signal_state_preset": c("signal_state_preset").isin(*SIGNAL_STATES),
            "signal_type": c("signal_type").isin(*DOMAINS["signal_type"]),
            "number_of_sequential_frames": c("number_of_sequential_frames") >= 1,
        },
        "audio_channel_pair": {"channel_pair": c("channel_pair").between(0, 7)},
        "dropout_run": {
            "frame_id": c("frame_id") >= 0, "sample_start": c("sample_start") >= 0, "sample_count": c("sample_count") > 0,
            "severity": c("severity").between(0, 100),
        },
        "efm_frame": {
            "frame_id": c("frame_id") >= 0, "t_value_offset": c("t_value_offset") >= 0, "t_value_count": c("t_value_count") >= 0,
        },
    }[table]


def constraint_violations(df: DataFrame, table: str) -> DataFrame:
    """S3: one row per violated constraint: the key columns, the constraint and how many rows break it together."""
    pk = TABLES[table]["pk"].split(",")
    broken = [F.when(F.col(c).isNull(), F.lit(f"not_null.{c}")) for c in _NOT_NULL[table]]
    broken += [F.when(~ok, F.lit(f"check.{name}")) for name, ok in checks(table).items()]
    rows = df.select(*pk, F.explode(F.array_compact(F.array(*broken))).alias("constraint"), F.lit(1).cast("bigint").alias("n_rows"))
    twice = df.groupBy(*pk).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select(
        *pk, F.lit("primary_key").alias("constraint"), "n_rows"
    )
    return rows.unionByName(twice)


def _group(table: str) -> Column:
    return F.expr(f"CAST({KEY} AS BIGINT) div {FILES_PER_FOLDER[table]}").alias(GROUP)


def _stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows with their folder, without the rows that only mark a file as empty."""
    rows = spark.read.schema(f"{TABLES[table]['schema']}, {GROUP} bigint").parquet(f"{path}/{table}")
    return rows.filter(F.coalesce(*(F.col(c).cast("string") for c in rows.columns if c not in (KEY, GROUP))).isNotNull())


def _in_folders(stored: DataFrame, files: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The stored rows in the folders of ``files``, and the distinct files; folders out of their range are not opened."""
    named = files.select(F.col(KEY).cast("bigint").alias(KEY)).distinct().select(F.col(KEY).alias("__file"), _group(table).alias("__folder"))
    low, high = named.agg(F.min("__folder"), F.max("__folder")).first()
    near = stored.filter(F.col(GROUP).between(low, high) | F.col(GROUP).isNull())
    return near.join(named.select("__folder").distinct(), F.col(GROUP).eqNullSafe(F.col("__folder")), "left_semi"), named


def write_sidecar(df: DataFrame, path: str, table: str, files: Sequence[int] | DataFrame | None = None) -> None:
    """Replace the rows of the files in ``df``; other files stay.

    ``files`` names all files of this run, so that one without rows loses its old ones: it gets one row without values, which replaces its
    old rows in the same commit and which ``read_sidecar`` leaves out. Files share folders (``FILES_PER_FOLDER``): a folder that is touched is
    written anew with the rows of its other files, so runs that write at the same time must not share one. The rebalance hint keeps
    small folders in few pieces and lets a very large one be written by many tasks.
    """
    spark = df.sparkSession
    types = dict(part.split(" ") for part in TABLES[table]["schema"].split(", "))
    rows = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    base = scratch_dir(spark, "replace")
    try:
        there = exists(spark, f"{path}/{table}")
        if there or files is not None:  # read more than once below, and maybe made from the table itself
            rows.write.parquet(base)
            rows = spark.read.schema(TABLES[table]["schema"]).parquet(base)
        if files is not None:
            named = files.select(KEY) if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], f"{KEY} bigint")
            gone = named.distinct().join(rows.select(KEY).distinct(), KEY, "left_anti")
            rows = rows.unionByName(gone, allowMissingColumns=True)
        if there:
            near, named = _in_folders(_stored(spark, path, table), rows, table)
            others = near.join(named, F.col(KEY).eqNullSafe(F.col("__file")), "left_anti")
            rows = rows.unionByName(others.drop(GROUP))
        (
            rows.withColumn(GROUP, _group(table)).hint("rebalance", GROUP).sortWithinPartitions(GROUP, KEY)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GROUP).parquet(f"{path}/{table}")
        )
    finally:
        remove(spark, base)


def read_sidecar(spark: SparkSession, path: str, table: str, files: DataFrame | None = None) -> DataFrame:
    """A sidecar table with its fixed schema, or its rows of ``files`` only, from their folders.

    Rows lie in the order of their files, so that a filter on the file skips what holds others.
    """
    rows = _stored(spark, path, table)
    if files is not None:
        near, named = _in_folders(rows, files, table)
        rows = near.join(named, F.col(KEY).eqNullSafe(F.col("__file")), "left_semi")
    return rows.drop(GROUP)


def cvbs_file_rows(projects: DataFrame, frames: DataFrame, flags: DataFrame, decoder: str = "framekit") -> DataFrame:
    """The ``cvbs_file`` row of each file.

    ``projects`` has the configuration (``standard, encoding, signal_state, signal_type, black_setup_ire``, null where it was not given),
    ``frames`` the number of frames (``n_frames``), ``flags`` whether samples left the profile (``has_nonstandard``); all by ``cvbs_file_id``. The black
    level is recorded only where an NTSC project asks for black at blanking, as that level's code. Made files are one unbroken sequence.
    """
    at_blanking = (F.col("standard") == "NTSC") & (F.abs(F.col("black_setup_ire")) < 1e-9)
    joined = projects.join(frames.select(KEY, "n_frames"), KEY, "left").join(flags.select(KEY, "has_nonstandard"), KEY, "left")
    none = F.lit(None).cast("string")
    return joined.select(
        F.col(KEY).cast("bigint").alias(KEY), F.col("standard").alias("preset"), F.col("encoding").alias("sample_encoding_preset"),
        F.col("signal_state").alias("signal_state_preset"), F.lit(True).alias("sequence_continuous"), "signal_type", F.lit(decoder).alias("decoder"),
        none.alias("git_branch"), none.alias("git_commit"), F.coalesce("n_frames", F.lit(0)).cast("bigint").alias("number_of_sequential_frames"),
        F.when(at_blanking, by_standard("blank_code", F.lit("NTSC"))).cast("int").alias("black_level"),
        F.coalesce("has_nonstandard", F.lit(False)).alias("has_nonstandard_values"), none.alias("capture_notes"),
    )


def audio_pair_rows(tracks: DataFrame) -> DataFrame:
    """``audio_channel_pair`` rows: the pairs that any section declares, with the first label in section order that is not empty.

    ``tracks`` has ``cvbs_file_id, section_no, channel_pair, label``.
    """
    labelled = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.struct("section_no", "label"))
    return tracks.filter("channel_pair is not null").groupBy(F.col(KEY).cast("bigint").alias(KEY), F.col("channel_pair").cast("int").alias("channel_pair")).agg(
        F.min(labelled)["label"].alias("description"),
    )


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Constraint counts over several sidecar tables."""
    parts = [
        constraint_violations(df, name).groupBy("constraint").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table_name"), "constraint", "n"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
