"""Q15 compiled: the rules of a configuration with one pass over each of its tables.

A report needs no findings, only their numbers and the names of failed rules. Checks are therefore bits of a number (:class:`Sheet`),
which are counted and combined where the rows are; one row per project goes on (:func:`verdicts`).

Rules across rows become facts: one aggregate of the sections and one of the test signals per project. The facts are joined to
projects and sections, so that every rule is a condition on one row; the findings of a table are one array per row, exploded once.
A project may hold a third of all sections: its facts are one row, and the join to its sections is left to adaptive execution.
Missing facts (no sections, no signals) count as none; null project ids have no facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.operators import rules as ru

#: Columns that sections take over from their project, whose values are judged there.
INHERITED = ("standard", "disc_type", "encoding", "signal_state", "signal_type")


def section_facts(sections: DataFrame, kind: str = "section_type") -> DataFrame:
    """One row per project of ``sections`` (section_no, section_type, ``kind`` for the order, carries_codes, pair).

    ``pairs`` holds at most the eight channel pairs that exist.
    """
    programme = F.when(F.col("section_type") == "programme_area", F.col("section_no"))
    pair = F.when(F.col("pair").between(0, 7), F.col("pair"))
    return sections.groupBy("project_id").agg(
        *[fact.alias(name) for name, fact in ru.bound_facts(F.col(kind)).items()], F.min(programme).alias("first_programme"), F.max("carries_codes").alias("any_code"),
        F.collect_set(pair).alias("pairs"), F.count("*").alias("n_sections"),
    )


def signal_facts(signals: DataFrame) -> DataFrame:
    """One row per project of ``signals`` (vits_type, line_no): whether it has the signals that other settings need."""
    return signals.groupBy("project_id").agg(
        F.max(F.col("vits_type") == "virs").alias("has_virs"),
        F.max(F.col("line_no") == 19).alias("has_19"), F.max(F.col("line_no") == 20).alias("has_20"),
    )


def _yes(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def project_checks(columns: Sequence[str]) -> list[ru.Check]:
    """Rules on a project of these columns that carries its facts."""
    std, disc, efm = F.col("standard"), F.col("disc_type"), F.col("efm_pair")
    no_pair = ~F.array_contains(F.coalesce("pairs", F.array().cast("array<int>")), efm.cast("int"))
    return [
        *ru.domain_checks(columns), *ru.range_checks(columns), *ru.project_completeness_checks(),
        ("complete.sections", ru.ERROR, F.col("n_sections").isNull(), F.lit("sections")),
        ("reference.disc_type", ru.ERROR, disc.isNull() & _yes("any_code"), F.lit("disc_type")),
        ("reference.virs", ru.ERROR, disc.isin("CAV", "CLV") & std.isin("NTSC", "PAL_M") & ~_yes("has_virs"), std),
        ("reference.efm_pair", ru.WARNING, efm.between(0, 7) & no_pair, efm),
        ("reference.efm_standard", ru.ERROR, efm.isNotNull() & ~F.coalesce(std.isin("PAL", "NTSC"), F.lit(False)), std),
    ]


def section_checks(columns: Sequence[str], kind: str) -> list[ru.Check]:
    """Rules on a section of these columns (of :func:`rules.with_lifespan`) that carries its project's facts."""
    pal = F.col("standard") == "PAL"
    no_line = ~F.when(pal, _yes("has_19")).otherwise(_yes("has_20"))
    return [
        *ru.domain_checks([c for c in columns if c not in INHERITED]), *ru.range_checks(columns), *ru.profile_checks(columns),
        ru.empty_check("source"), *ru.duration_checks(), *ru.ramp_checks(),
        *ru.track_checks(F.col("section_type") == "programme_area"), *ru.ordering_checks(F.col(kind)),
        ("reference.spread_line", ru.WARNING, (F.col("noise_spread_db") > 0) & no_line, F.when(pal, 19).otherwise(20)),
    ]


def configuration_findings(projects: DataFrame, sections: DataFrame, signals: DataFrame, kind: str = "section_type") -> DataFrame:
    """Findings of Q1, Q2, Q4, Q6, Q7, Q9, Q10 and Q14 on projects, their sections and test signals.

    ``projects``: project_id, standard, disc_type, efm_pair, placement, video_path, signal_type and any ranged or enumerated columns;
    ``sections``: the columns of the duration and profile rules, noise_spread_db, pair, and ``kind``, the type by which they are ordered;
    ``signals``: project_id, vits_type, line_no.
    """
    facts, lines = section_facts(sections, kind), signal_facts(signals)
    told = projects.join(facts, "project_id", "left").join(lines, "project_id", "left")
    placed = ru.with_lifespan(sections).join(facts.drop("pairs", "any_code", "n_sections"), "project_id", "left").join(
        lines.drop("has_virs"), "project_id", "left"
    )
    placement = projects.select("project_id", "standard", "disc_type", "placement")
    on_lines = signals.drop("section_no").join(placement, "project_id", "left")
    return ru.all_findings([
        ru.findings(told, project_checks(projects.columns)), ru.findings(placed, section_checks(sections.columns, kind)),
        ru.findings(facts, ru.bound_checks()), ru.findings(on_lines, [*ru.reserved_checks(), ru.empty_check("vits_type")]),
    ])


class Sheet:
    """The rules of some rows as bits of a BIGINT, at most 62: each added check takes the next bit."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []

    def marks(self, checks: Sequence[ru.Check]) -> Column:
        """The bits of the checks that hold on a row; null conditions do not."""
        first = len(self.rules)
        self.rules += [(rule, severity) for rule, severity, _, _ in checks]
        if len(self.rules) > 62:
            raise ValueError("a sheet holds 62 rules")
        none = F.lit(0).cast("bigint")
        return any_of(*[
            F.when(cond, F.lit(1 << i).cast("bigint")).otherwise(none) for i, (_, _, cond, _) in enumerate(checks, first)
        ])

    def bits(self, severity: str, rule: str | None = None) -> int:
        """The bits of a severity, or of one rule of it, which may have several."""
        return sum(1 << i for i, (r, s) in enumerate(self.rules) if s == severity and rule in (None, r))

    def count(self, marks: Column, severity: str) -> Column:
        """How many of the marked rules have the severity."""
        return F.bit_count(marks.bitwiseAND(F.lit(self.bits(severity)).cast("bigint")))


def any_of(*marks: Column) -> Column:
    return reduce(Column.bitwiseOR, marks)


def counted(sheet: Sheet, name: str, *marks: Column) -> dict[str, Column]:
    """Columns of marks, which have no bit in common, and the number of errors among them.

    Each of the ``marks`` occurs twice in the select that takes the columns, so that Spark makes it a short method of its own.
    """
    errors = reduce(Column.__add__, [sheet.count(m, ru.ERROR) for m in marks])
    return {name: any_of(*marks), f"{name}_errors": errors}


def failed_rules(sheets: dict[str, Sheet]) -> Column:
    """Names of the errors marked in the columns of that name, in order, joined by commas; null marks are none."""
    names = sorted({rule for sheet in sheets.values() for rule, severity in sheet.rules if severity == ru.ERROR})
    none = F.lit(0).cast("bigint")

    def failed(rule: str) -> Column:
        bits = {column: sheet.bits(ru.ERROR, rule) for column, sheet in sheets.items()}
        return reduce(Column.__or__, [F.col(column).bitwiseAND(F.lit(b).cast("bigint")) != none for column, b in bits.items() if b])

    return F.array_join(F.array_compact(F.array(*[F.when(failed(rule), F.lit(rule)) for rule in names])), ",")


def summary(found: DataFrame, sheet: Sheet) -> DataFrame:
    """One row per project of findings whose rules are in the ``sheet``; null projects are left out.

    n_errors, n_warnings; n_open, the errors without a section; first_section with errors and n_first, its errors; the marks of failed rules.
    """
    bad = F.col("severity") == ru.ERROR
    mark = reduce(
        lambda chain, rule: chain.when(F.col("rule") == rule, F.lit(sheet.bits(ru.ERROR, rule)).cast("bigint")),
        sorted({rule for rule, _ in sheet.rules}), F.when(F.lit(False), F.lit(0).cast("bigint")),
    )
    sections = found.filter("project_id IS NOT NULL").select(
        "project_id", "section_no", bad.alias("bad"), F.when(bad, mark).otherwise(F.lit(0).cast("bigint")).alias("marks")
    ).repartition("project_id").groupBy("project_id", "section_no").agg(
        F.count(F.when(F.col("bad"), 1)).alias("e"), F.count(F.when(~F.col("bad"), 1)).alias("w"), F.bit_or("marks").alias("marks")
    )
    return sections.groupBy("project_id").agg(*summed(F.col("e"), F.col("w"), F.col("section_no")), F.bit_or("marks").alias("marks"))


def summed(errors: Column, warnings: Column, section: Column) -> list[Column]:
    """Aggregates of a project over the numbers of its sections, one row each; a null section stands for the project."""
    at = F.when(errors > 0, section)
    return [
        F.sum(errors).alias("n_errors"), F.sum(warnings).alias("n_warnings"),
        F.coalesce(F.sum(F.when(section.isNull(), errors)), F.lit(0)).alias("n_open"),
        F.min(at).alias("first_section"), F.min_by(errors, at).alias("n_first"),
    ]


def verdicts(projects: DataFrame, sheets: dict[str, Sheet], parts: Sequence[str]) -> DataFrame:
    """The report of rows with the columns of :func:`summary` for each part, prefixed by its name, and the marks of the ``sheets``.

    A report that stops at the first section with an error has that section's errors and those without a section.
    """
    def total(column: str) -> Column:
        return reduce(Column.__add__, [F.coalesce(f"{part}_{column}", F.lit(0)) for part in parts])

    firsts = [F.col(f"{part}_first_section") for part in parts]
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    at_first = reduce(Column.__add__, [
        F.when(at == F.col("__first"), F.col(f"{part}_n_first")).otherwise(0) for part, at in zip(parts, firsts)
    ])
    rows = projects.withColumn("__first", first).select(
        "project_id", total("n_errors").alias("n_errors"), total("n_warnings").alias("n_warnings"), total("n_open").alias("n_open"),
        "__first", at_first.alias("__at_first"), failed_rules(sheets).alias("failed_rules"),
    )
    return rows.select(
        "project_id", (F.col("n_errors") == 0).alias("is_valid"), "n_errors", "n_warnings",
        F.least("__first", F.when(F.col("n_open") > 0, 0)).alias("first_error_section"), "failed_rules",
        (F.col("n_open") + F.col("__at_first")).alias("first_only_errors"),
    )
