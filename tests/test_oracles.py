"""Queries against their DuckDB texts at the smallest scale. FRAMEKIT_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import difference, duck

SF = os.environ.get("FRAMEKIT_SF", "/root/testdata/sf0.001")
QUICK = [
    "expand_schedule", "timecodes", "clv_picture_number", "frame_index_table", "sample_to_frame", "merge_intervals",
    "split_at_boundaries", "runs_to_lines", "dropout_coverage", "scratch_lifespan", "apply_runs_to_samples",
    "decode_code_words", "vote_frame_codes", "picture_number_continuity", "frame_map", "verify_checksums", "code_coverage",
    "quantise_samples", "nonstandard_rollup", "resample_linear", "requantise_24_to_16", "measure_noise", "pulse_widths",
    "border_check", "diff_manifests", "table_digest", "compare_captures", "diff_regions", "project_diff", "best_of_runs",
    "resolve_tokens", "resolve_paths", "derive_variants", "rule_unique", "rule_hex_words", "rule_tokens", "rule_exclusive",
    "constraint_violations", "parse_run_logs", "stream_sidecar_dedup", "read_raw_frames", "stream_continuity", "stream_dropout_rate",
    "stream_dropout_bursts", "stream_validate", "section_runs", "sequence_phase", "expected_words", "mute_overlap",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return duck(SF)


@pytest.mark.parametrize("slug", sorted(entry.queries()) if os.environ.get("FRAMEKIT_ALL") else QUICK)
def test_query_equals_its_text(spark, con, slug):
    if slug not in entry.oracle_sql():
        assert entry.queries()[slug](spark, SF).limit(1).count() == 1
    else:
        assert difference(spark, con, entry.queries()[slug], entry.oracle_sql()[slug], SF) is None


def test_entry_has_rows(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
