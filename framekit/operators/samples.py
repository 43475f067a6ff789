"""Operators on sample arrays, one row per line or frame.

Arrays stay arrays: higher-order functions run inside the row. Rows are exploded only where a
statistic over samples is the result, and then the aggregate combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from framekit.dims import STANDARDS, by_standard
from framekit.functions.clocks import idiv

FIXED_BITS = 20
RECIPROCAL_BITS = 30
CHROMA_CENTRE = 512
LEGAL_LOW, LEGAL_HIGH = 4, 1019
INT16 = (-32768, 32767)


def to_fixed(mv: Column) -> Column:
    """Millivolts as BIGINT with 20 fraction bits, rounded half away from zero."""
    return F.round(mv * float(1 << FIXED_BITS)).cast("bigint")


def _reciprocal(standard: Column) -> Column:
    expr = None
    for name, values in STANDARDS.items():
        value = F.lit(round((1 << RECIPROCAL_BITS) / values["mv_per_code"])).cast("bigint")
        expr = F.when(standard == name, value) if expr is None else expr.when(standard == name, value)
    return expr


def mapped_code(fixed: Column, standard: Column, rounding: str = "fixed", centre: Column | None = None) -> Column:
    """Unclamped 10-bit code of a fixed-point level.

    ``fixed`` rounding subtracts the half before an arithmetic shift, so negative codes come out one
    below the nearest; ``nominal`` rounds half away from zero.
    """
    base = by_standard("blank_code", standard) if centre is None else centre
    if rounding == "fixed":
        bits = FIXED_BITS + RECIPROCAL_BITS
        product = fixed * _reciprocal(standard)
        half = F.lit(1 << (bits - 1)).cast("bigint")
        delta = F.when(product >= 0, F.shiftright(product + half, bits)).otherwise(F.shiftright(product - half, bits))
    elif rounding == "nominal":
        delta = F.round(fixed / float(1 << FIXED_BITS) / by_standard("mv_per_code", standard)).cast("bigint")
    else:
        raise ValueError("rounding is 'fixed' or 'nominal'")
    return (delta + base).cast("bigint")


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high).cast("bigint")), F.lit(low).cast("bigint"))


def encode_sample(fixed: Column, standard: Column, encoding: str, rounding: str, chroma: bool = False) -> Column:
    """One output word of an encoding: U10/U16 codes, TPG21, S16 relative to blanking, or RAW millivolts."""
    if encoding.startswith("RAW_S16"):
        return _clamp(F.round(fixed / float(1 << FIXED_BITS)).cast("bigint"), *INT16)
    code = mapped_code(fixed, standard, rounding, F.lit(CHROMA_CENTRE) if chroma else None)
    if encoding == "CVBS_S16_4FSC":
        return _clamp((code - by_standard("blank_code", standard)) * 32, *INT16)
    legal = _clamp(code, LEGAL_LOW, LEGAL_HIGH)
    if encoding == "CVBS_TPG21_4FSC":
        return (legal - 508) * 64
    if encoding in ("CVBS_U10_4FSC", "CVBS_U16_4FSC"):
        return legal
    raise ValueError(f"unknown encoding {encoding}")


def quantise_samples(
    lines: DataFrame, encoding: str, signal_type: str = "composite", rounding: str = "fixed",
    standard: str = "standard",
) -> DataFrame:
    """Millivolt arrays ``y`` (and ``c``) to output words: ``codes``, and ``chroma_codes`` for yc output."""
    std = F.col(standard)

    def words(arr: Column, chroma: bool) -> Column:
        return F.transform(arr, lambda x: encode_sample(x, std, encoding, rounding, chroma).cast("int"))

    luma = F.transform("y", to_fixed)
    rest = [c for c in lines.columns if c not in ("y", "c")]
    if signal_type == "yc":
        return lines.select(
            *rest, words(luma, False).alias("codes"), words(F.transform("c", to_fixed), True).alias("chroma_codes")
        )
    if "c" in lines.columns:
        luma = F.zip_with(luma, F.transform("c", to_fixed), lambda a, b: a + b)
    return lines.select(*rest, words(luma, False).alias("codes"))


def nonstandard_rollup(
    lines: DataFrame, by: Sequence[str], encoding: str = "CVBS_U10_4FSC", signal_type: str = "composite", frame: str = "frame_id", standard: str = "standard",
    line: str | None = None,
) -> DataFrame:
    """Per file: any sample outside the profile's codes (one code of slack), how many, and the first position.

    Composite output is tested as the sum of luma ``y`` and chroma ``c``, yc output by its luma, and RAW output, which holds no codes, never.
    With several rows per frame ``line`` orders them; positions count samples within the row, and ``first_line`` tells the row.
    """
    std = F.col(standard)
    low, high = by_standard("min_code", std) - 1, by_standard("max_code", std) + 1
    fixed = F.transform("y", to_fixed)
    if signal_type == "composite" and "c" in lines.columns:
        fixed = F.zip_with(fixed, F.transform("c", to_fixed), lambda a, b: a + F.coalesce(b, F.lit(0)))

    def odd(x: Column) -> Column:
        code = mapped_code(x, std)
        return (code < low) | (code > high)

    flags = F.array().cast("array<boolean>") if encoding.startswith("RAW_S16") else F.transform(fixed, odd)
    row = F.col(line).cast("bigint") if line else F.lit(1).cast("bigint")
    rows = lines.select(*by, frame, row.alias("__line"), F.array_position(flags, F.lit(True)).alias("__first"), F.size(F.filter(flags, lambda f: f)).alias("__n"))
    at = F.when(F.col("__n") > 0, F.struct(F.col(frame).alias("frame"), F.col("__line").alias("line"), (F.col("__first") - 1).alias("sample")))
    return rows.groupBy(*by).agg(
        F.max(F.col("__n") > 0).alias("has_nonstandard"), F.sum("__n").cast("bigint").alias("n_nonstandard"), F.min(at).alias("__at"),
    ).select(
        *by, "has_nonstandard", "n_nonstandard", F.col("__at.frame").alias("first_frame"), F.col("__at.line").alias("first_line"),
        F.col("__at.sample").alias("first_sample"),
    )


def resample_linear(lines: DataFrame, target: Column | int, samples: str = "samples") -> DataFrame:
    """Linear resampling of each array to ``target`` values; integers are rounded half away from zero."""
    n = (F.lit(target) if isinstance(target, int) else target).cast("int")
    src = F.col(samples)
    last = (F.size(src) - 1).cast("double")

    def value(i: Column) -> Column:
        pos = last * (i.cast("double") / (n - 1).cast("double"))
        left = F.floor(pos).cast("int")
        right = F.least(left + 1, F.size(src) - 1)
        part = pos - left
        return F.round((F.lit(1.0) - part) * src[left] + part * src[right]).cast("bigint")

    flat = F.transform(F.sequence(F.lit(1), n), lambda _: src[0].cast("bigint"))
    moved = F.transform(F.sequence(F.lit(0), n - 1), value)
    out = F.when((F.size(src) == 0) | (n < 1), F.array().cast("array<bigint>")).when(
        (F.size(src) == 1) | (n == 1), flat
    ).otherwise(moved)
    return lines.withColumn(samples, out)


def resample_frames(frames: DataFrame, target: int, samples: str = "samples") -> DataFrame:
    """N4 for whole-frame arrays: the same rule, vectorised per frame in Arrow batches."""

    @pandas_udf("array<bigint>")
    def run(col):  # type: ignore[no-untyped-def]
        import numpy as np
        import pandas as pd

        def one(values):  # type: ignore[no-untyped-def]
            v = np.asarray(values, dtype="float64")
            if target < 1 or v.size == 0:
                return np.zeros(0, dtype="int64")
            if v.size == 1 or target == 1:
                return np.full(target, int(v[0]), dtype="int64")
            pos = (v.size - 1) * (np.arange(target) / (target - 1))
            left = pos.astype("int64")
            right = np.minimum(left + 1, v.size - 1)
            part = pos - left
            x = (1.0 - part) * v[left] + part * v[right]
            return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype("int64")

        return pd.Series([one(v) for v in col])

    return frames.withColumn(samples, run(F.col(samples)))


def requantise_24_to_16(rows: DataFrame, samples: str = "samples") -> DataFrame:
    """24-bit to 16-bit samples, half away from zero, saturated; ``n_saturated`` counts the clipped ones."""
    def rounded(x: Column) -> Column:
        v = x.cast("bigint")
        size = idiv(F.abs(v) + 128, 256)
        return F.when(v < 0, -size).otherwise(size)

    return rows.select(
        *[c for c in rows.columns if c != samples],
        F.transform(samples, lambda x: _clamp(rounded(x), *INT16).cast("int")).alias(samples),
        F.size(F.filter(samples, lambda x: (rounded(x) > INT16[1]) | (rounded(x) < INT16[0]))).alias("n_saturated"),
    )


def measure_noise(lines: DataFrame, by: Sequence[str], white_mv: float | Column, samples: str = "samples") -> DataFrame:
    """Mean, standard deviation and SNR in dB of the samples in each group."""
    white = F.lit(white_mv) if isinstance(white_mv, float) else white_mv
    rows = lines.select(*by, F.explode(samples).alias("__x"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("__x").alias("mean_mv"), F.stddev_pop("__x").alias("stddev_mv")
    ).withColumn("snr_db", F.when(F.col("stddev_mv") > 0, F.log10(white / F.col("stddev_mv")) * 20.0))


def pulse_widths(lines: DataFrame, threshold: float | Column, samples: str = "samples") -> DataFrame:
    """Start and width of the first stretch at or below the threshold (null start and width 0 if none)."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    below = F.transform(samples, lambda x: x <= limit)
    first = F.array_position(below, F.lit(True)).cast("int")
    tail = F.slice(below, F.greatest(first, F.lit(1)), F.size(below))
    stop = F.array_position(tail, F.lit(False)).cast("int")
    return lines.select(
        *[c for c in lines.columns if c != samples],
        F.when(first > 0, first - 1).alias("pulse_start"),
        F.when(first > 0, F.when(stop > 0, stop - 1).otherwise(F.size(tail))).otherwise(0).alias("pulse_width"),
    )


def _camera_gamma(x: Column) -> Column:
    """Transfer function from linear light to the gamma-corrected signal."""
    return F.when(x <= 0, 0.0).when(x < 0.018, x * 4.5).otherwise(F.pow(x, F.lit(0.45)) * 1.099 - 0.099)


def component_stats(rows: DataFrame, image: str = "image_id", stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """Luma and colour-difference ranges, 8-bit round-trip error and edge ratio per image.

    ``rows``: image, row ``y``, arrays ``r``, ``g``, ``b`` of linear light in [0, 1]. Each pixel is paired with its
    neighbour inside the row's array, and only the pairs are exploded, so a row is not copied to its pixels.
    """
    step_x, step_y = (max(1, s) for s in stride)
    light = F.arrays_zip("r", "g", "b")

    def signal(p: Column) -> Column:
        r, g, b = (_camera_gamma(p[c]) for c in "rgb")
        luma = r * 0.299 + g * 0.587 + b * 0.114
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), luma.alias("y"), (r - luma).alias("dr"), (b - luma).alias("db"))

    lit_rows = rows.filter(F.col("y") % step_y == 0).select(image, F.transform(light, signal).alias("__s"))
    at = F.filter(F.sequence(F.lit(0), F.size("__s"), F.lit(step_x)), lambda x: x < F.size("__s"))
    made = lit_rows.select(image, F.transform(at, lambda x: F.struct(F.get("__s", x).alias("p"), F.get("__s", x + 1).alias("q"))).alias("__pairs"))
    # outer, as the plain form makes the optimiser work the whole row out a second time to see whether it is empty
    pairs = made.select(image, F.inline_outer("__pairs")).filter("p is not null")
    y, cr, cb = F.col("p.y") * 219.0 + 16.0, F.col("p.dr") * 160.0 + 128.0, F.col("p.db") * 126.0 + 128.0

    def byte(x: Column) -> Column:
        return F.greatest(F.least(F.rint(x), F.lit(255.0)), F.lit(0.0))

    def unit(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))

    luma = (byte(y) - 16.0) / 219.0
    red = luma + (byte(cr) - 128.0) / 160.0
    blue = luma + (byte(cb) - 128.0) / 126.0
    green = (luma - red * 0.299 - blue * 0.114) / 0.587
    error = sum(
        (F.abs((unit(a) - F.col(f"p.{c}")) * 255.0) for a, c in ((red, "r"), (green, "g"), (blue, "b"))), F.lit(0.0)
    ) / 3.0
    luma_edge = F.abs(F.col("q.y") - F.col("p.y"))
    colour_edge = (F.abs(F.col("q.dr") - F.col("p.dr")) + F.abs(F.col("q.db") - F.col("p.db"))) * 0.5
    stats = pairs.select(
        image, y.alias("y"), cb.alias("cb"), cr.alias("cr"), error.alias("e"), luma_edge.alias("le"), colour_edge.alias("ce")
    ).groupBy(image).agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{n}") for c in ("y", "cb", "cr") for n, f in (("min", F.min), ("max", F.max))],
        F.avg("e").alias("mean_error"), F.max("e").alias("max_error"), F.sum("ce").alias("__ce"), F.sum("le").alias("__le"),
    )
    ratio = F.coalesce(F.col("__ce"), F.lit(0.0)) / F.greatest(F.coalesce(F.col("__le"), F.lit(0.0)), F.lit(1e-12))
    return stats.withColumn("edge_ratio", ratio).drop("__ce", "__le")


def border_check(
    rows: DataFrame, width: int, left: int, right: int, threshold: float, image: str = "image_id", examples: int = 5
) -> DataFrame:
    """Border pixels above the black threshold per image and the first examples in raster order.

    ``rows``: image, row ``y``, arrays ``r``, ``g``, ``b``. Only the two ends of a row are looked at, within its arrays; a row sends its
    counts and at most ``examples`` positions.
    """
    columns = [x for x in range(width) if x < left or x >= width - right]
    inside = F.filter(F.array(*(F.lit(x) for x in columns)).cast("array<int>"), lambda x: x < F.size("r"))
    bad = F.filter(inside, lambda x: (F.get("r", x) > threshold) | (F.get("g", x) > threshold) | (F.get("b", x) > threshold))
    found = rows.select(image, "y", F.size(inside).alias("__n"), bad.alias("__bad"))
    counts = found.groupBy(image).agg(F.sum("__n").cast("bigint").alias("border_pixels"), F.sum(F.size("__bad")).cast("bigint").alias("bad_pixels"))
    order = Window.partitionBy(image).orderBy("y", "x")
    some = found.filter(F.size("__bad") > 0).select(image, "y", F.explode(F.slice("__bad", 1, examples)).alias("x"))
    first = some.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= examples).groupBy(image).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__rank", "x", "y"))), lambda e: F.format_string("%d,%d", e["x"], e["y"])
            ), ";",
        ).alias("examples")
    )
    return counts.join(first, image, "left").withColumn("ok", F.col("bad_pixels") == 0)


def check_report(checks: DataFrame, by: str = "path", strict: bool = False) -> DataFrame:
    """PASS or FAIL per file from rows (file, name, ok, severity); warnings fail only when ``strict``.

    The failure list holds distinct check names, of which there are a fixed few.
    """
    counted = ~F.col("ok") if strict else ~F.col("ok") & (F.col("severity") == "FAIL")
    return checks.groupBy(by).agg(
        F.when(F.max(counted), "FAIL").otherwise("PASS").alias("verdict"),
        F.count("*").alias("n_checks"), F.count(F.when(~F.col("ok"), 1)).alias("n_not_ok"),
        F.array_join(F.array_sort(F.collect_set(F.when(counted, F.col("name")))), ",").alias("failures"),
    )
