"""Rules over configuration tables (Q1-Q15). Each gives rows (project_id, section_no, rule, severity, detail).

Rules on one row are an array of findings that is exploded, so any number of them is one pass over the
table. Rules across rows are aggregates per project joined back, or semi and anti joins; none collects
the sections of a project.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.dims import (
    DISC_TEST_LINES, MAX_CHAPTER, RESERVED_RANGES, STANDARDS, VITS_LINES, by_standard,
)
from framekit.operators.intervals import dropout_params
from framekit.operators.text import ROOTS, unknown_tokens

ERROR, WARNING = "error", "warning"
SCHEMA = ["project_id", "section_no", "rule", "severity", "detail"]
#: A rule on one row: its name, severity, condition and detail.
Check = tuple[str, str, Column, Column]

# The allowed values of each enumerated field.
DOMAINS: dict[str, list[str]] = {
    "standard": ["PAL", "NTSC", "PAL_M"],
    "encoding": ["CVBS_U10_4FSC", "CVBS_U16_4FSC", "CVBS_TPG21_4FSC", "CVBS_S16_4FSC", "RAW_S16_28M", "RAW_S16_40M"],
    "signal_state": ["STANDARD_STABLE_LOCKED"],
    "signal_type": ["composite", "yc"],
    "disc_type": ["CAV", "CLV"],
    "section_type": ["lead_in", "programme_area", "lead_out"],
    "injection_type": ["laserdisc", "vitc"],
    "waveform": ["sine", "square", "sawtooth", "triangle"],
    "ramp_mode": ["up", "down", "bounce"],
    "fg": ["white", "light_grey", "dark_grey", "black"],
    "bg": ["transparent", "white", "light_grey", "dark_grey", "black"],
}
# Code types by disc type and by section type.
CAV_CODES = [
    "lead_in", "lead_out", "picture_number", "picture_stop", "chapter_number", "programme_status", "users_code",
    "fm_picture_number", "fm_white_flag",
]
CLV_CODES = [
    "lead_in", "lead_out", "programme_time_code", "clv_code", "clv_picture_number", "chapter_number",
    "programme_status", "users_code", "fm_programme_time", "fm_white_flag",
]
SYSTEM_M_CODES = ["fm_picture_number", "fm_programme_time", "fm_white_flag"]
ALL_CODES = sorted(set(CAV_CODES) | set(CLV_CODES))
DOMAINS["code_type"] = ALL_CODES
CODE_SECTIONS = {
    code: ["lead_in"] if code == "lead_in" else ["lead_out"] if code == "lead_out"
    else ["lead_in", "lead_out"] if code == "users_code"
    else ["lead_in", "programme_area", "lead_out"] if code == "fm_white_flag" else ["programme_area"]
    for code in ALL_CODES
}
# Shortest lead-in and lead-out, noise range and largest picture numbers.
LEAD_IN_FRAMES, LEAD_OUT_FRAMES = 938, 1250
NOISE_DB = (20.0, 61.0)
MAX_PICTURE = {"PAL": 99999, "NTSC": 79999, "PAL_M": 79999}


def _ids(df: DataFrame) -> list[Column]:
    section = F.col("section_no") if "section_no" in df.columns else F.lit(None)
    return [F.col("project_id"), section.cast("int").alias("section_no")]


def findings(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Rows for each (rule, severity, condition, detail) whose condition holds; null conditions do not."""
    made = [
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), detail.cast("string").alias("detail")))
        for rule, sev, cond, detail in checks
    ]
    return df.select(*_ids(df), F.explode(F.array_compact(F.array(*made))).alias("__f")).select(
        "project_id", "section_no", "__f.*"
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*SCHEMA) for p in parts])


def domain_checks(columns: Sequence[str]) -> list[Check]:
    """Domain rules of the enumerated columns among ``columns``."""
    return [
        (f"domain.{c}", ERROR, F.col(c).isNotNull() & ~F.col(c).isin(*DOMAINS[c]), F.col(c)) for c in columns if c in DOMAINS
    ]


def rule_domain(*tables: DataFrame) -> DataFrame:
    """Q1: values outside their set, for every enumerated column that the tables have; null is unset."""
    return _union([findings(df, domain_checks(df.columns)) for df in tables if domain_checks(df.columns)])


def _outside(col: str, low: float, high: float) -> Column:
    return ~F.col(col).between(low, high)


def range_checks(columns: Sequence[str]) -> list[Check]:
    """Range rules whose columns are present."""
    c = F.col
    known_lines = by_standard("lines")
    rules: list[tuple[str, list[str], Column]] = [
        ("noise_db", ["noise_db"], _outside("noise_db", *NOISE_DB)),
        ("noise_spread", ["noise_spread_db"], c("noise_spread_db") < 0),
        ("white_snr", ["noise_db", "noise_spread_db"], (c("noise_spread_db") >= 0) & (c("noise_db") - c("noise_spread_db") < NOISE_DB[0])),
        ("random_scale", ["random_scale"], _outside("random_scale", 0, 20)),
        ("scratch_scale", ["scratch_scale"], _outside("scratch_scale", 0, 20)),
        ("osd_scale", ["osd_scale"], _outside("osd_scale", 1, 4)),
        ("amplitude", ["amplitude"], _outside("amplitude", 0.0, 1.0)),
        ("frequency", ["frequency_hz"], _outside("frequency_hz", 0.0, 22000.0)),
        ("ramp_start", ["ramp_start_hz"], _outside("ramp_start_hz", 0.0, 22000.0)),
        ("ramp_end", ["ramp_end_hz"], _outside("ramp_end_hz", 0.0, 22000.0)),
        ("ramp_period", ["ramp_period_s"], c("ramp_period_s") < 0),
        ("picture_number", ["picture_start", "standard"], (c("picture_start") < 0) | (c("picture_start") > _max_picture())),
        ("fm_picture_number", ["fm_start"], _outside("fm_start", 0, 79999)),
        ("chapter", ["chapter"], _outside("chapter", 0, MAX_CHAPTER)),
        ("pair", ["pair"], _outside("pair", 0, 7)),
        ("efm_pair", ["efm_pair"], _outside("efm_pair", 0, 7)),
        ("line", ["line_no", "standard"], (c("line_no") < 1) | (c("line_no") > known_lines)),
        ("black_setup", ["black_setup_ire", "standard"], c("standard").isin("NTSC", "PAL_M") & ~c("black_setup_ire").isin(0.0, 7.5)),
    ]
    details = {
        name: F.concat_ws(" ", *[F.col(x).cast("string") for x in need if x != "standard"]) for name, need, _ in rules
    }
    return [(f"range.{n}", ERROR, cond, details[n]) for n, need, cond in rules if all(x in columns for x in need)]


def _max_picture() -> Column:
    out = None
    for name, top in MAX_PICTURE.items():
        out = F.when(F.col("standard") == name, top) if out is None else out.when(F.col("standard") == name, top)
    return out


def rule_range(*tables: DataFrame) -> DataFrame:
    """Q2: numbers outside their range, for every known column that the tables have."""
    return _union([findings(df, range_checks(df.columns)) for df in tables if range_checks(df.columns)])


def _duplicates(df: DataFrame, keys: Sequence[str], rule: str, value: str) -> DataFrame:
    seen = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1)
    return findings(seen, [(rule, ERROR, F.lit(True), F.col(value))])


def rule_unique(target_lines: DataFrame, project_lines: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Q3: a line claimed twice in a section or project, a channel pair twice in a section."""
    parts = [_duplicates(target_lines, ["project_id", "section_no", "line_no"], "unique.section_line", "line_no")]
    if project_lines is not None:
        parts.append(_duplicates(project_lines, ["project_id", "line_no"], "unique.project_line", "line_no"))
    if pairs is not None:
        parts.append(_duplicates(pairs, ["project_id", "section_no", "pair"], "unique.pair", "pair"))
    return _union(parts)


def reserved_checks() -> list[Check]:
    """Rules on test signal lines (standard, disc_type, placement, vits_type, line_no); the fixed tables are part of the conditions."""
    std, line = F.col("standard"), F.col("line_no")
    no = F.lit(False)
    held = reduce(Column.__or__, [(std == s) & line.between(*r) for s, ranges in RESERVED_RANGES.items() for r in ranges])
    open_line = reduce(Column.__or__, [(std == s) & line.isin(*lines) for s, lines in DISC_TEST_LINES.items()])
    own = F.when(std == "PAL_M", "NTSC").otherwise(std)
    usual = F.when(no, 0)
    for name, signals in VITS_LINES.items():
        for kind, usual_line in signals.items():
            usual = usual.when((own == name) & (F.col("vits_type") == kind), usual_line)
    return [
        ("reserved.disc_range", ERROR, F.col("disc_type").isin("CAV", "CLV") & held, line),
        ("reserved.disc_placement", ERROR, (F.col("placement") == "laserdisc") & ~F.coalesce(open_line, no), line),
        ("reserved.standard_placement", ERROR, (F.col("placement") == "standard") & (usual > 0) & (line != usual), line),
    ]


def rule_reserved_lines(lines: DataFrame) -> DataFrame:
    """Q4: test signal lines in reserved ranges of discs, or against the placement policy.

    ``lines``: project_id, standard, disc_type, placement, vits_type, line_no.
    """
    return findings(lines, reserved_checks()).select(*SCHEMA)


def compatibility_checks(code: Column | None = None) -> list[Check]:
    """Rules on codes (code_type or the stated ``code``, section_type, disc_type, standard) of projects with a disc type."""
    code = F.col("code_type") if code is None else code
    on_disc = F.col("disc_type").isin("CAV", "CLV")
    allowed = {
        "disc_type": {c: [d for d, codes in (("CAV", CAV_CODES), ("CLV", CLV_CODES)) if c in codes] for c in ALL_CODES},
        "section_type": CODE_SECTIONS,
        "standard": {c: [s for s in STANDARDS if s != "PAL" or c not in SYSTEM_M_CODES] for c in ALL_CODES},
    }
    checks = []
    for other, sets in allowed.items():
        kinds = F.create_map(*[x for code, names in sets.items() for x in (F.lit(code), F.array(*map(F.lit, names)))])
        fits = F.coalesce(F.array_contains(kinds[code], F.col(other)), F.lit(False))
        checks.append((f"compatibility.{other}", ERROR, on_disc & ~fits, F.concat_ws("/", code, other)))
    return checks


def rule_compatibility(codes: DataFrame) -> DataFrame:
    """Q5: codes that the disc type, section type or standard does not allow, unknown ones included. Projects without disc type pass.

    ``codes``: project_id, section_no, code_type, section_type, disc_type, standard.
    """
    return findings(codes, compatibility_checks()).select(*SCHEMA)


def rule_references(
    projects: DataFrame, codes: DataFrame, vits: DataFrame, pairs: DataFrame, noise: DataFrame
) -> DataFrame:
    """Q6: things that a setting needs elsewhere in the project.

    ``projects``: project_id, standard, disc_type, efm_pair; ``codes``: project_id; ``vits``: project_id,
    vits_type, line_no; ``pairs``: project_id, pair; ``noise``: project_id, section_no, noise_spread_db, standard.
    """
    no_disc = projects.filter("disc_type IS NULL").join(codes.select("project_id"), "project_id", "left_semi")
    virs = vits.filter("vits_type = 'virs'").select("project_id")
    no_virs = projects.filter(F.col("disc_type").isin("CAV", "CLV") & F.col("standard").isin("NTSC", "PAL_M")).join(
        virs, "project_id", "left_anti"
    )
    efm = projects.filter("efm_pair IS NOT NULL")
    no_pair = efm.filter(F.col("efm_pair").between(0, 7)).join(
        pairs.select("project_id", F.col("pair").alias("efm_pair")), ["project_id", "efm_pair"], "left_anti"
    )
    wrong_efm = efm.filter(~F.coalesce(F.col("standard").isin("PAL", "NTSC"), F.lit(False)))
    line = F.when(F.col("standard") == "PAL", 19).otherwise(20)
    spread = noise.filter("noise_spread_db > 0").withColumn("line_no", line).join(
        vits.select("project_id", "line_no"), ["project_id", "line_no"], "left_anti"
    )
    yes = F.lit(True)
    return _union([
        findings(no_disc, [("reference.disc_type", ERROR, yes, F.lit("disc_type"))]),
        findings(no_virs, [("reference.virs", ERROR, yes, F.col("standard"))]),
        findings(no_pair, [("reference.efm_pair", WARNING, yes, F.col("efm_pair"))]),
        findings(wrong_efm, [("reference.efm_standard", ERROR, yes, F.col("standard"))]),
        findings(spread, [("reference.spread_line", WARNING, yes, F.col("line_no"))]),
    ])


def bound_facts(kind: Column) -> dict[str, Column]:
    """Aggregates of a project's sections that the ordering rules need, by name."""
    return {
        "n_in": F.count(F.when(kind == "lead_in", 1)), "n_out": F.count(F.when(kind == "lead_out", 1)),
        "first_in": F.min(F.when(kind == "lead_in", F.col("section_no"))),
        "last_out": F.max(F.when(kind == "lead_out", F.col("section_no"))),
    }


def bound_checks() -> list[Check]:
    """Ordering rules on a project's facts."""
    return [
        ("ordering.one_lead_in", ERROR, F.col("n_in") > 1, F.col("n_in")),
        ("ordering.one_lead_out", ERROR, F.col("n_out") > 1, F.col("n_out")),
    ]


def ordering_checks(kind: Column | None = None) -> list[Check]:
    """Ordering rules on a section that carries its project's facts."""
    kind = F.col("section_type") if kind is None else kind
    at = F.col("section_no")
    bounded = (F.col("n_in") > 0) | (F.col("n_out") > 0)
    inside = (at > F.coalesce("first_in", F.lit(-1))) & (at < F.coalesce("last_out", F.lit(1 << 30)))
    known = F.coalesce(kind.isin(*DOMAINS["section_type"]), F.lit(False))
    return [
        ("ordering.before_lead_in", ERROR, at < F.col("first_in"), kind),
        ("ordering.after_lead_out", ERROR, at > F.col("last_out"), kind),
        ("ordering.between", ERROR, bounded & inside & ~known, kind),
    ]


def rule_ordering(sections: DataFrame) -> DataFrame:
    """Q7: one lead-in and one lead-out at most, nothing before or after them, programme between.

    ``sections``: project_id, section_no, section_type.
    """
    kind = F.col("section_type")
    bounds = sections.groupBy("project_id").agg(*[v.alias(k) for k, v in bound_facts(kind).items()]).filter("n_in > 0 OR n_out > 0")
    return _union([findings(bounds, bound_checks()), findings(sections.join(bounds, "project_id"), ordering_checks())])


def rule_exclusive(injections: DataFrame) -> DataFrame:
    """Q8: injections that must not meet. ``injections``: project_id, section_no, type, n_lines."""
    return _union([findings(injections, exclusive_checks()), exclusive_pairs(injections)])


def exclusive_checks() -> list[Check]:
    """Rules on one injection (type, n_lines)."""
    kind = F.lower("type")
    return [
        ("exclusive.section_vits", ERROR, kind == "vits", F.col("type")),
        ("exclusive.disc_lines", ERROR, (kind == "laserdisc") & (F.col("n_lines") > 0), F.col("n_lines")),
        ("exclusive.missing_lines", ERROR, (kind == "vitc") & (F.coalesce("n_lines", F.lit(0)) == 0), F.col("type")),
    ]


def exclusive_pairs(injections: DataFrame) -> DataFrame:
    """Sections with both kinds of injected code lines."""
    kind = F.lower("type")
    both = injections.groupBy("project_id", "section_no").agg(
        F.max(kind == "laserdisc").alias("__disc"), F.max(kind == "vitc").alias("__vitc")
    )
    return findings(both, [("exclusive.vitc_disc", ERROR, F.col("__disc") & F.col("__vitc"), F.lit("vitc"))])


def rule_durations(sections: DataFrame, ramps: DataFrame | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """Q9: lengths that are too short or contradict each other.

    ``sections``: duration_frames, duration_all, duration_repeat, section_type, disc_type, carries_codes,
    scratch_scale. ``ramps`` adds ramp_period_s and standard; ``tracks`` are programme sections of projects
    with disc audio (standard, duration_frames, duration_all).
    """
    parts = [findings(with_lifespan(sections), duration_checks())]
    if ramps is not None:
        parts.append(findings(ramps, ramp_checks()))
    if tracks is not None:
        first = tracks.groupBy("project_id").agg(F.min("section_no").alias("first_programme"))
        parts.append(findings(tracks.join(first, "project_id"), track_checks()))
    return _union(parts)


def with_lifespan(sections: DataFrame) -> DataFrame:
    """Sections with the frames that a scratch of their scale lasts, ``__life``."""
    return dropout_params(sections, "scratch_scale").withColumnRenamed("scratch_frames", "__life")


def duration_checks() -> list[Check]:
    """Rules on the length of one section (of :func:`with_lifespan`)."""
    fixed, n = ~F.col("duration_all"), F.col("duration_frames")
    cav = (F.col("disc_type") == "CAV") & F.col("carries_codes") & fixed
    return [
        ("duration.lead_in", WARNING, cav & (F.col("section_type") == "lead_in") & (n < LEAD_IN_FRAMES), n),
        ("duration.lead_out", WARNING, cav & (F.col("section_type") == "lead_out") & (n < LEAD_OUT_FRAMES), n),
        ("duration.positive", ERROR, fixed & (n <= 0), n),
        ("duration.repeat", ERROR, F.col("duration_repeat") < 1, F.col("duration_repeat")),
        ("duration.repeat_ignored", WARNING, fixed & (F.col("duration_repeat") > 1), F.col("duration_repeat")),
        ("duration.scratch", WARNING, fixed & F.col("scratch_scale").between(1, 20) & (F.col("__life") > n), F.col("__life")),
    ]


def ramp_checks() -> list[Check]:
    """A ramp's period against its section's length."""
    period, seconds = F.col("ramp_period_s"), F.col("duration_frames") / by_standard("frame_rate")
    return [("duration.ramp", ERROR, ~F.col("duration_all") & (period > 0) & (period > seconds), period)]


def track_checks(of: Column | None = None) -> list[Check]:
    """A track's length, given its project's ``first_programme`` section; ``of`` narrows the sections that are tracks."""
    n = F.col("duration_frames")
    least = F.when(F.col("section_no") == F.col("first_programme"), 6.0).otherwise(4.0)
    short = ~F.col("duration_all") & (n > 0) & (n / by_standard("frame_rate") < least)
    return [("duration.track", WARNING, short if of is None else of & short, n)]


def rule_source_profile(*profiles: DataFrame) -> DataFrame:
    """Q10: source properties against the section's standard and file family; null or zero is unknown and passes.

    ``profiles``: project_id, section_no, source, standard, and any of container, codec, pixel_format, bit_depth,
    width, height, frame_rate, sample_aspect, field_order, color_space, color_primaries, color_transfer,
    color_range, crop.
    """
    return _union([findings(df, profile_checks(df.columns)) for df in profiles])


def profile_checks(columns: Sequence[str]) -> list[Check]:
    """Source rules whose columns are present. The names, rasters, rates and tolerances are fixed values."""
    c, std = F.col, F.col("standard")
    exr, mkv = F.lower("source").endswith(".exr"), F.lower("source").endswith(".mkv")
    pal = std == "PAL"
    rate = F.when(pal, 25.0).otherwise(30000.0 / 1001.0)
    aspect = F.when(pal, 128.0 / 117.0).otherwise(108.0 / 119.0)
    primaries = F.when(pal, F.array(F.lit("bt470bg"))).when(std == "NTSC", F.array(F.lit("smpte170m"))).otherwise(
        F.array(F.lit("bt470bg"), F.lit("smpte170m"))
    )
    rules: list[tuple[str, list[str], Column]] = [
        ("family", [], ~exr & ~mkv),
        ("raster", ["width", "height"], (c("width") > 0) & (c("height") > 0) & ~((c("width") == 720) & (c("height") == F.when(pal, 576).otherwise(486)))),
        ("frame_rate", ["frame_rate"], (c("frame_rate") > 0) & (F.abs(c("frame_rate") - rate) > 1.0e-3)),
        ("container", ["container"], (exr & (F.lower("container") != "exr")) | (mkv & ~F.array_contains(F.split(F.lower("container"), ","), "matroska"))),
        ("codec", ["codec"], (exr & (F.lower("codec") != "openexr")) | (mkv & (F.lower("codec") != "ffv1"))),
        ("pixel_format", ["pixel_format"], (exr & (F.lower("pixel_format") != "rgbf")) | (mkv & (F.lower("pixel_format") != "yuv422p10le"))),
        ("bit_depth", ["bit_depth"], (exr & (c("bit_depth") != 32)) | (mkv & (c("bit_depth") > 0) & (c("bit_depth") != 10))),
        ("color_space", ["color_space"], mkv & (c("color_space") != "smpte170m")),
        ("field_order", ["field_order"], mkv & (c("field_order") != F.when(pal, "tb").otherwise("bt"))),
        ("color_primaries", ["color_primaries"], mkv & ~F.array_contains(primaries, c("color_primaries"))),
        ("color_transfer", ["color_transfer"], mkv & (c("color_transfer") != "bt709") & ~F.array_contains(primaries, c("color_transfer"))),
        ("color_range", ["color_range"], mkv & (c("color_range") != "") & (c("color_range") != "tv")),
        ("sample_aspect", ["sample_aspect"], mkv & (c("sample_aspect") > 0) & (F.abs(c("sample_aspect") - aspect) > 2.0e-3)),
        ("crop", ["crop"], mkv & (c("crop") != 0)),
    ]
    return [
        (f"profile.{name}", ERROR, cond, F.concat_ws(" ", *[c(x).cast("string") for x in (need or ["source"])]))
        for name, need, cond in rules if all(x in columns for x in need)
    ]


def parse_word(text: Column) -> Column:
    """BIGINT of a number by its base: 0x and hexadecimal, 0 and octal, else decimal; null when it is none of these."""
    hexadecimal = F.regexp_extract(text, r"^0[xX]([0-9a-fA-F]{1,15})$", 1)
    octal = F.regexp_extract(text, r"^0([0-7]{1,20})$", 1)
    decimal = F.regexp_extract(text, r"^(0|[1-9][0-9]{0,17})$", 1)
    return (
        F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("bigint"))
        .when(octal != "", F.conv(octal, 8, 10).cast("bigint")).when(decimal != "", decimal.cast("bigint"))
    )


def rule_hex_words(codes: DataFrame) -> DataFrame:
    """Q11: user and status words: a number, at most 24 bits, and the bits that their format fixes.

    ``codes``: project_id, section_no, code_type, word_text (null is unset).
    """
    return findings(codes.withColumn("__w", parse_word(F.col("word_text"))), hex_checks())


def hex_checks() -> list[Check]:
    """Rules on the parsed word ``__w`` of a code (code_type, word_text)."""
    typed = F.col("code_type").isin("users_code", "programme_status") & F.col("word_text").isNotNull()
    w, user = F.col("__w"), F.col("code_type") == "users_code"
    small = w <= 0xFFFFFF
    checks = [
        ("hex.number", w.isNull()), ("hex.bits", w > 0xFFFFFF),
        ("hex.x1", user & small & (F.shiftright(w, 16).bitwiseAND(15) > 7)),
        ("hex.d", user & small & (F.shiftright(w, 12).bitwiseAND(15) != 13)),
        ("hex.key", ~user & small & (w.bitwiseAND(0x800000) == 0)),
    ]
    return [(rule, ERROR, typed & cond, F.col("word_text")) for rule, cond in checks]


def rule_tokens(overlays: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Q12: unknown tokens in overlay text, unknown or open asset roots in paths."""
    parts = []
    if overlays is not None:
        found = overlays.withColumn("__u", unknown_tokens(F.col("text")))
        parts.append(findings(found, [("token.overlay", ERROR, F.size("__u") > 0, F.array_join(F.array_sort("__u"), ","))]))
    if paths is not None:
        opened = F.col("path").startswith("{")
        root = F.regexp_extract("path", r"^\{([^}]*)\}", 1)
        closed = F.col("path").rlike(r"^\{[^}]*\}")
        parts.append(findings(paths, [
            ("token.open_root", ERROR, opened & ~closed, F.col("path")),
            ("token.root", ERROR, opened & closed & ~root.isin(*ROOTS), root),
        ]))
    return _union(parts)


def rule_unknown_keys(blocks: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Q13: keys of JSON blocks outside the set of their block type. ``blocks``: block, body (JSON text)."""
    sets = F.create_map(*[x for k, keys in allowed.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in keys]))])
    extra = F.array_except(F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")), sets[F.col("block")])
    rows = blocks.withColumn("__x", extra)
    return findings(rows, [("keys.unknown", ERROR, F.size("__x") > 0, F.concat_ws(":", F.col("block"), F.array_join(F.array_sort("__x"), ",")))])


def rule_completeness(projects: DataFrame, sections: DataFrame, vits: DataFrame | None = None) -> DataFrame:
    """Q14: empty source, path or signal name, projects without sections, luma suffix for yc output.

    ``projects``: project_id, video_path, signal_type; ``sections``: project_id, section_no, source.
    """
    parts = [
        findings(projects, project_completeness_checks()),
        findings(projects.join(sections.select("project_id"), "project_id", "left_anti"), [
            ("complete.sections", ERROR, F.lit(True), F.lit("sections"))
        ]),
        findings(sections, [empty_check("source")]),
    ]
    if vits is not None:
        parts.append(findings(vits, [empty_check("vits_type")]))
    return _union(parts)


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def empty_check(c: str) -> Check:
    """The column ``c`` must be given."""
    return (f"complete.{c}", ERROR, _empty(c), F.lit(c))


def project_completeness_checks() -> list[Check]:
    """Rules on a project (video_path, signal_type)."""
    path = F.col("video_path")
    no_suffix = (F.col("signal_type") == "yc") & ~_empty("video_path") & ~path.endswith(".cvbsy")
    return [empty_check("video_path"), ("complete.yc_suffix", ERROR, no_suffix, path)]


def all_findings(found: Sequence[DataFrame]) -> DataFrame:
    """Findings of several rules as one table."""
    return _union(found)


def first_failures(found: DataFrame) -> DataFrame:
    """Findings up to the first section with an error in each project, as a check that stops there reports them."""
    stop = found.filter((F.col("severity") == ERROR) & F.col("section_no").isNotNull()).groupBy("project_id").agg(
        F.min("section_no").alias("__stop")
    )
    return found.join(stop, "project_id", "left").filter(
        F.col("section_no").isNull() | F.col("__stop").isNull() | (F.col("section_no") <= F.col("__stop"))
    ).drop("__stop")


def validation_report(projects: DataFrame, found: Sequence[DataFrame], first_only: bool = False) -> DataFrame:
    """Q15: verdict per project over all rules; warnings do not fail it.

    The findings of a project are counted, never collected; the list of failed rules has as many entries
    at most as there are rules.
    """
    rows = _union(found)
    if first_only:
        rows = first_failures(rows)
    bad = F.col("severity") == ERROR
    counts = rows.groupBy("project_id").agg(
        F.count(F.when(bad, 1)).alias("n_errors"), F.count(F.when(~bad, 1)).alias("n_warnings"),
        F.min(F.when(bad, F.coalesce("section_no", F.lit(0)))).alias("first_error_section"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("rule")))), ",").alias("failed_rules"),
    )
    return projects.select("project_id").join(counts, "project_id", "left").select(
        "project_id", (F.coalesce("n_errors", F.lit(0)) == 0).alias("is_valid"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
        "first_error_section", F.coalesce("failed_rules", F.lit("")).alias("failed_rules"),
    )
