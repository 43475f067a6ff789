"""Fixed values of the three video standards, as column expressions and small tables.

Every table here has a fixed row count (a few to a few dozen rows), so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values per standard (line and sample counts, levels, ranges).
STANDARDS = {
    "PAL": {
        "lines": 625, "samples_per_line": 1135, "samples_per_frame": 709379,
        "frame_rate": 25.0, "sample_rate": 17734475.0,
        "sync_mv": -300.0, "blank_mv": 0.0, "black_mv": 0.0, "white_mv": 700.0,
        "mv_per_code": 1.1905, "blank_code": 256, "min_code": 4, "max_code": 1019,
        "clamp_min_mv": -300.006, "clamp_max_mv": 908.452,
        "active_start": 24970, "active_end": 707104,
        "field1_last_line": 312, "colour_period": 4, "code_fps": 25,
        "frames_per_minute": 1500, "max_picture": 99999,
    },
    "NTSC": {
        "lines": 525, "samples_per_line": 910, "samples_per_frame": 477750,
        "frame_rate": 30000.0 / 1001.0, "sample_rate": 14318180.0,
        "sync_mv": -285.7, "blank_mv": 0.0, "black_mv": 53.6, "white_mv": 714.3,
        "mv_per_code": 1.2755, "blank_code": 240, "min_code": 16, "max_code": 1019,
        "clamp_min_mv": -285.712, "clamp_max_mv": 993.984,
        "active_start": 19110, "active_end": 474109,
        "field1_last_line": 262, "colour_period": 2, "code_fps": 30,
        "frames_per_minute": 1800, "max_picture": 79999,
    },
    "PAL_M": {
        "lines": 525, "samples_per_line": 909, "samples_per_frame": 477225,
        "frame_rate": 30000.0 / 1001.0, "sample_rate": 14318445.96,
        "sync_mv": -285.7, "blank_mv": 0.0, "black_mv": 53.6, "white_mv": 714.3,
        "mv_per_code": 1.2755, "blank_code": 240, "min_code": 16, "max_code": 1019,
        "clamp_min_mv": -285.712, "clamp_max_mv": 993.984,
        "active_start": 19089, "active_end": 473588,
        "field1_last_line": 262, "colour_period": 4, "code_fps": 25,
        "frames_per_minute": 1500, "max_picture": 99999,
    },
}

# Inclusive ranges of lines reserved for code words, and lines open to test signals on discs.
RESERVED_RANGES = {
    "PAL": [(6, 18), (319, 331)],
    "NTSC": [(10, 18), (273, 281)],
    "PAL_M": [(10, 18), (273, 281)],
}
DISC_TEST_LINES = {
    "PAL": [19, 20, 332, 333],
    "NTSC": [19, 20, 282, 283],
    "PAL_M": [19, 20, 282, 283],
}

# 24-bit words that carry no field.
WORD_LEAD_IN = 0x88FFFF
WORD_LEAD_OUT = 0x80EEEE
WORD_PICTURE_STOP = 0x82CFFF
WORD_CLV = 0x87FFFF
MAX_CHAPTER = 79
STOP_BIT_FRAMES = 400
# Fractions of a line at which words start, and the length of the white flag.
FLAG_START_H, FLAG_LENGTH_H, STATUS_START_H, FM_START_H = 0.160, 0.790, 0.172, 0.215


def by_standard(field: str, standard: Column | str = "standard") -> Column:
    """The fixed value ``field`` of the row's standard; null for an unknown standard."""
    col = F.col(standard) if isinstance(standard, str) else standard
    expr = None
    for name, values in STANDARDS.items():
        branch = F.lit(values[field])
        expr = F.when(col == name, branch) if expr is None else expr.when(col == name, branch)
    return expr


def standard_dim(spark: SparkSession) -> DataFrame:
    fields = list(STANDARDS["PAL"])
    rows = [(name, *[vals[f] for f in fields]) for name, vals in STANDARDS.items()]
    return spark.createDataFrame(rows, ["standard", *fields])


def reserved_line_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, lo, hi) for s, ranges in RESERVED_RANGES.items() for lo, hi in ranges]
    return spark.createDataFrame(rows, "standard string, line_lo int, line_hi int")


def disc_test_line_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, line) for s, lines in DISC_TEST_LINES.items() for line in lines]
    return spark.createDataFrame(rows, "standard string, line_no int")


# Candidate codes per line, in priority order. Field-2 lines repeat the field-1 rule.
_CAV = {
    16: ["picture_stop", "programme_status"],
    17: ["picture_number", "picture_stop", "chapter_number"],
    18: ["chapter_number", "picture_number"],
}
_CLV = {
    16: ["clv_picture_number", "programme_status"],
    17: ["programme_time_code", "clv_code"],
    18: ["chapter_number", "programme_time_code"],
}
_FIELD_2_SHIFT = {"PAL": 313, "NTSC": 263, "PAL_M": 263}


def _line_rules() -> list[tuple]:
    rules: list[tuple] = []

    def put(std: str, section: str, disc: str, line: int, codes: list[str], both: bool, always: bool = False) -> None:
        lines = [line, line + _FIELD_2_SHIFT[std]] if both else [line]
        for target in lines:
            for rank, code in enumerate(codes):
                early = code == "programme_status" or (code == "clv_code" and std != "PAL")
                offset = (
                    FLAG_START_H if code == "fm_white_flag"
                    else STATUS_START_H if early
                    else FM_START_H if code.startswith("fm_")
                    else None
                )
                rules.append((std, section, disc, target, rank, code, always, offset))

    for std in STANDARDS:
        for disc in ("CAV", "CLV"):
            for area, marker in (("lead_in", "lead_in"), ("lead_out", "lead_out")):
                put(std, area, disc, 16, ["users_code"], True)
                put(std, area, disc, 17, [marker], True, always=True)
                put(std, area, disc, 18, [marker], True, always=True)
            for line, codes in (_CAV if disc == "CAV" else _CLV).items():
                put(std, "programme_area", disc, line, codes, True)
            if std != "PAL":
                put(std, "lead_in", disc, 11, ["fm_white_flag"], False)
                put(std, "lead_out", disc, 11, ["fm_white_flag"], True)
                put(std, "programme_area", disc, 11, ["fm_white_flag"], False)
                fm = "fm_picture_number" if disc == "CAV" else "fm_programme_time"
                put(std, "programme_area", disc, 10, [fm], True)
    return rules


def line_rule_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        _line_rules(),
        "standard string, section_type string, disc_type string, line_no int, priority int, "
        "code_type string, always boolean, start_h double",
    )


# Test signal catalogue with the recommended frame line (0 = any line).
VITS_LINES = {
    "PAL": {
        "vits17": 17, "itu-multiburst": 18, "uk-national": 19, "vits20": 20,
        "itu-composite": 330, "itu-combination": 331,
    },
    "NTSC": {
        "ntc7-composite": 17, "ntc7-combination": 280, "fcc-multiburst": 18,
        "fcc-composite": 281, "virs": 0,
    },
}


def vits_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, name, line) for s, entries in VITS_LINES.items() for name, line in entries.items()]
    return spark.createDataFrame(rows, "standard string, vits_type string, recommended_line int")


def line_geometry(spark: SparkSession) -> DataFrame:
    """One row per (standard, line): sample offset and count, field, active and reserved flags.

    The 4fsc PAL frame is not an even number of samples per line: lines 313 and 625 hold two more.
    """
    lines = spark.createDataFrame([(s,) for s in STANDARDS], "standard string").select(
        "standard", F.explode(F.sequence(F.lit(1), by_standard("lines"))).alias("line_no")
    )
    spl = by_standard("samples_per_line")
    long_line = (F.col("standard") == "PAL") & F.col("line_no").isin(313, 625)
    before = F.when((F.col("standard") == "PAL") & (F.col("line_no") > 313), 2).otherwise(0)
    out = lines.select(
        "standard",
        "line_no",
        ((F.col("line_no") - 1) * spl + before).cast("bigint").alias("sample_offset"),
        (spl + F.when(long_line, 2).otherwise(0)).cast("int").alias("sample_count"),
        F.when(F.col("line_no") <= by_standard("field1_last_line"), 1).otherwise(2).cast("int").alias("field"),
    )
    reserved = F.lit(False)
    for std, ranges in RESERVED_RANGES.items():
        for lo, hi in ranges:
            reserved = reserved | ((F.col("standard") == std) & F.col("line_no").between(lo, hi))
    first, last = by_standard("active_start"), by_standard("active_end")
    return out.select(
        "*",
        ((F.col("sample_offset") + F.col("sample_count") > first) & (F.col("sample_offset") <= last)).alias("is_active"),
        reserved.alias("is_reserved"),
    )
