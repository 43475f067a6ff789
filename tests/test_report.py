"""The compiled report against the rules one by one, and fixtures that reach every rule."""

import random

import pytest
from pyspark.sql import functions as F

from framekit.operators import report, rules
from framekit.plans import q_rules
from framekit.plans.registry import ORACLES
from tests.oracle_check import duck

SF = "/root/testdata/sf0.01"

PROJECTS = (
    "project_id bigint, standard string, disc_type string, encoding string, signal_state string, signal_type string, placement string, "
    "black_setup_ire double, efm_pair int, video_path string"
)
SECTIONS = (
    "project_id bigint, section_no int, section_type string, ordered_as string, standard string, disc_type string, duration_frames int, "
    "duration_all boolean, duration_repeat int, carries_codes boolean, scratch_scale int, noise_db double, noise_spread_db double, "
    "ramp_period_s double, pair int, source string, codec string, width int, height int, waveform string"
)
SIGNALS = "project_id bigint, line_no int, vits_type string"


def drawn(seed):
    """Random rows with nulls in every column, projects without sections, sections and signals without a project, and repeats."""
    r = random.Random(seed)

    def of(*values):
        return r.choice([*values, None])

    projects = [
        (i, of("PAL", "NTSC", "PAL_M", "SECAM"), of("CAV", "CLV", "DVD"), of("CVBS_U8", "RAW_S16_28M"), of("STANDARD_STABLE_LOCKED", "x"),
         of("yc", "rgb"), of("standard", "laserdisc"), of(0.0, 5.0), of(0, 3, 9), of("", "a.cvbs", "a.cvbsy"))
        for i in [*range(40), None]
    ]
    at = {p[0]: p for p in projects}
    sections = []
    for _ in range(160):
        p = of(*range(5, 45))
        std, disc = (at[p][1:3] if p in at else (None, None))
        kind = of("lead_in", "lead_out", "programme_area", "other")
        sections.append((
            p, of(1, 2, 3, 4), kind, r.choice([kind, None]), std, disc, of(-1, 3, 120, 1300), r.choice([True, False]), of(0, 1, 2),
            r.choice([True, False]), of(0, 1, 20, 30), of(10.0, 30.0), of(-1.0, 0.0, 15.0), of(0.1, 90.0), of(0, 3, 9),
            of("", "a.exr", "a.mkv", "a.avi"), of("ffv1", "openexr"), of(720, 704), of(576, 486), of("sine", "noise"),
        ))
    signals = [(of(*range(45)), of(8, 17, 19, 20, 281, 333), of("virs", "vits17", "fcc-composite", "")) for _ in range(120)]
    return projects, sections, signals


def one_by_one(projects, sections, signals):
    ordered = sections.select("project_id", "section_no", F.col("ordered_as").alias("section_type"))
    placed = signals.join(projects.select("project_id", "standard", "disc_type", "placement"), "project_id")
    own = sections.drop("standard", "disc_type")
    return rules.all_findings([
        rules.rule_domain(projects, own), rules.rule_range(projects, sections), rules.rule_reserved_lines(placed),
        rules.rule_references(
            projects, sections.filter("carries_codes"), signals, sections.select("project_id", "pair"), sections
        ),
        rules.rule_ordering(ordered), rules.rule_durations(sections, sections, sections.filter("section_type = 'programme_area'")),
        rules.rule_source_profile(sections), rules.rule_completeness(projects, sections, signals),
    ])


@pytest.mark.parametrize("seed", [1, 2])
def test_compiled_findings_are_those_of_the_rules(spark, seed):
    tables = [spark.createDataFrame(rows, schema) for rows, schema in zip(drawn(seed), (PROJECTS, SECTIONS, SIGNALS))]

    def rows(df):
        return sorted(map(str, df.select(*rules.SCHEMA).collect()))

    got = rows(report.configuration_findings(*tables, "ordered_as"))
    assert got == rows(one_by_one(*tables)) and len({g.split("rule=")[1].split(",")[0] for g in got}) > 30


def test_empty_configuration_has_no_findings(spark):
    tables = [spark.createDataFrame([], schema) for schema in (PROJECTS, SECTIONS, SIGNALS)]
    assert report.configuration_findings(*tables, "ordered_as").count() == 0


def test_each_table_is_read_once_per_use(spark):
    """Facts are one aggregate per table; the rules add no further joins or scans."""
    tables = [spark.createDataFrame(rows, schema) for rows, schema in zip(drawn(3), (PROJECTS, SECTIONS, SIGNALS))]
    plan = report.configuration_findings(*tables, "ordered_as")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 4 and plan.count("Join ") == 5


def test_fixtures_reach_every_rule():
    con = duck(SF)

    def reached(slug):
        return {r[0] for r in con.sql(f"SELECT DISTINCT rule FROM ({ORACLES[slug]}) q").fetchall()}

    ranges = "noise_db noise_spread white_snr random_scale scratch_scale osd_scale amplitude frequency ramp_start ramp_end ramp_period"
    ranges += " picture_number fm_picture_number chapter pair efm_pair line black_setup"
    profile = "family raster frame_rate container codec pixel_format bit_depth color_space field_order color_primaries color_transfer"
    profile += " color_range sample_aspect crop"
    assert reached("rule_domain") == {f"domain.{c}" for c in rules.DOMAINS}
    assert reached("rule_range") == {f"range.{c}" for c in ranges.split()}
    assert reached("rule_source_profile") == {f"profile.{c}" for c in profile.split()}
    assert reached("rule_compatibility") == {f"compatibility.{c}" for c in ("disc_type", "section_type", "standard")}
    assert set(q_rules.FAMILIES) <= set(ORACLES)
