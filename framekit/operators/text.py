"""Overlay text, paths, variants and catalogues."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.dims import vits_dim
from framekit.functions.clocks import hmsf
from framekit.session import cut

# The tokens that overlay text may hold, and the asset roots a path may start with.
TOKENS = ["picture_number", "biphase_hex", "phase_id", "section_name", "timecode", "frame_number"]
ROOTS = ["bundled", "user", "project", "output"]


def _shown(picture: Column) -> Column:
    return F.when(picture > 0, F.format_string("%05d", picture)).otherwise("00000")


def token_values() -> dict[str, Column]:
    """Text of each token; needs picture_number, phase_id, words, section_name, frame_number, standard, disc_type."""
    word_text = F.array_join(F.transform("words", lambda w: F.lpad(F.hex(w), 6, "0")), " ")
    clv = F.coalesce(F.col("disc_type") == "CLV", F.lit(False))
    return {
        "picture_number": _shown(F.coalesce("picture_number", F.lit(0))),
        "biphase_hex": F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, word_text).otherwise("000000"),
        "phase_id": F.col("phase_id").cast("string"),
        "section_name": F.coalesce("section_name", F.lit("")),
        "timecode": F.when(clv, hmsf(F.col("frame_number") - 1)).otherwise("00:00:00:00"),
        "frame_number": F.format_string("%05d", F.col("frame_number")),
    }


def resolve_tokens(overlays: DataFrame, text: str = "text") -> DataFrame:
    """Replace known tokens in one pass from left to right; unknown tokens and open braces stay as they are.

    The text is cut into tokens, plain stretches and lone braces, so inserted values are never scanned again.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"(\{[^}]*\}|[^{]+|\{)"), F.lit(1))
    values = token_values()

    def swap(piece: Column) -> Column:
        out = None
        for name, value in values.items():
            hit = piece == "{" + name + "}"
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(piece)

    return overlays.withColumn("resolved", F.array_join(F.transform(pieces, swap), ""))


def unknown_tokens(text: Column) -> Column:
    """Token names in the text that are not known."""
    names = F.regexp_extract_all(text, F.lit(r"\{([^}]*)\}"), F.lit(1))
    return F.array_except(names, F.array(*[F.lit(t) for t in TOKENS]))


def normal_path(path: Column) -> Column:
    """Path without empty, ``.`` and resolvable ``..`` parts; a trailing slash stays."""
    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).when(
            (part == "..") & path.startswith("/") & (F.size(acc) == 0), acc
        ).otherwise(F.array_append(acc, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.startswith("/"), "/").otherwise("")
    tail = F.when(path.endswith("/") & (F.size(parts) > 0), "/").otherwise("")
    return F.concat(lead, F.array_join(parts, "/"), tail)


def _join_base(base: Column, path: Column) -> Column:
    whole = path.startswith("/") | (path == "") | (base == "")
    return F.when(whole, path).otherwise(normal_path(F.concat(base, F.lit("/"), path)))


def resolve_paths(rows: DataFrame, roots: dict[str, str], path: str = "path", project_dir: str = "project_dir", anchor: bool = True) -> DataFrame:
    """Replace a leading ``{root}`` by its folder. ``project``, and ``output`` without a folder, are the
    project's folder; unknown roots stay; relative folders lie below the project's folder.
    """
    raw, home = F.col(path), F.col(project_dir)
    has_root = raw.rlike(r"^\{[^}]*\}")
    name = F.regexp_extract(raw, r"^\{([^}]*)\}", 1)
    rest = F.regexp_extract(raw, r"(?s)^\{[^}]*\}[/\\]?(.*)$", 1)
    base = F.when(name == "project", home)
    if "output" not in roots:
        base = base.when(name == "output", home)
    for root, folder in roots.items():
        if root != "project":
            base = base.when(name == root, _join_base(home, F.lit(folder)))
    under = F.when(base.isNull(), raw).when(rest == "", base).otherwise(_join_base(base, rest))
    plain = _join_base(home, raw) if anchor else raw
    return rows.withColumn("resolved_path", F.when(raw == "", raw).when(has_root, under).otherwise(plain))


def companion_paths(rows: DataFrame, path: str = "resolved_path", pair: int = 0, metadata: str | None = None) -> DataFrame:
    """Metadata, chroma, audio and dropout sidecar paths of a sample file.

    ``metadata`` names a column of given metadata paths; null or empty ones are derived from the sample file. Dropouts lie beside the
    metadata, whatever it is called. A null path has no companions but those of given metadata.
    """
    raw = F.col(path)
    bare = F.regexp_replace(raw, r"\.cvbsy?$", "")
    stem = F.when(bare != raw, bare).otherwise(F.regexp_replace(raw, r"\.[^./\\]*$", ""))
    meta = F.concat(stem, F.lit(".meta"))
    if metadata is not None:
        meta = F.when(F.col(metadata) != "", F.col(metadata)).otherwise(meta)
    return rows.select(
        *rows.columns, meta.alias("meta_path"),
        F.when(raw.endswith(".cvbsy"), F.regexp_replace(raw, r"\.cvbsy$", ".cvbsc")).alias("chroma_path"),
        F.concat(bare, F.lit(f"_audio_{pair}.wav")).alias("audio_path"),
        F.concat(F.regexp_replace(meta, r"\.meta$", ""), F.lit(".dropouts.meta")).alias("dropouts_path"),
    )


# File suffix of each signal type.
SUFFIX_OF = {"composite": ".cvbs", "yc": ".cvbsy"}


def _path_pattern(pattern: str) -> str:
    """A path pattern as a regular expression; stars and question marks do not cross slashes."""
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch)) for ch in pattern) + "$"


def derive_variants(projects: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Configurations derived by variant rules, in order; a rule also sees what earlier rules made.

    A rule has name, sources (path patterns), and optionally name_suffix, remove (columns to clear) and
    signal_type. ``projects``: path, video_path, signal_type and the block columns. Where two sources give one path, the last in
    path order wins. Each rule's rows are written before the next reads them, so a plan holds one scan per earlier rule.
    """
    levels = [projects]
    types = dict(projects.dtypes)
    for rule in rules:
        wanted = reduce(Column.__or__, [F.col("path").rlike(_path_pattern(p)) for p in rule["sources"]])
        add, signal = rule.get("name_suffix", ""), rule.get("signal_type")
        stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
        changes = {
            "path": F.concat(F.lit(rule["name"] + "/"), stem, F.lit(add + ".yaml")),
            "video_path": F.concat(F.regexp_replace("video_path", r"\.cvbsy?$", ""), F.lit(add + SUFFIX_OF[signal or "composite"])),
            **{c: F.lit(None).cast(types[c]) for c in rule.get("remove", ())},
            **({"signal_type": F.lit(signal)} if signal else {}),
        }
        seen = reduce(DataFrame.unionByName, [level.select(*projects.columns) for level in levels])
        derived = seen.filter(wanted).withColumn("__source", F.col("path")).withColumns(changes)
        row = F.struct(*(c for c in projects.columns if c != "path"))
        winner = derived.groupBy("path").agg(F.max_by(row, "__source").alias("__row")).select("path", "__row.*", F.lit(rule["name"]).alias("variant"))
        levels.append(cut(winner.select(*projects.columns, "variant"), "variants"))
    return reduce(DataFrame.unionByName, levels[1:])


def catalogue_lookup(rows: DataFrame) -> DataFrame:
    """Recommended line of a test signal; PAL_M falls back on NTSC; unknown signals are unsupported."""
    dim = F.broadcast(vits_dim(rows.sparkSession))
    own = dim.select("standard", "vits_type", F.col("recommended_line").alias("__own"))
    ntsc = dim.filter("standard = 'NTSC'").select("vits_type", F.col("recommended_line").alias("__ntsc"))
    line = F.coalesce("__own", F.when(F.col("standard") == "PAL_M", F.col("__ntsc")))
    return rows.join(own, ["standard", "vits_type"], "left").join(ntsc, "vits_type", "left").select(
        *rows.columns, line.alias("recommended_line"), line.isNotNull().alias("supported")
    )


def pair_catalogue(pairs: DataFrame, key: str = "project_id", order: str = "section_no") -> DataFrame:
    """Channel pairs of each project with the first non-empty description in section order."""
    said = F.length(F.coalesce("description", F.lit(""))) > 0
    return pairs.groupBy(key, "pair").agg(
        F.min_by("description", F.when(said, F.col(order))).alias("description"), F.count("*").alias("n_sections")
    )
