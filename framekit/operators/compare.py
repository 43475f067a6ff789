"""Manifests, capture comparison and duplicates (M1-M9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.functions.clocks import idiv


#: 32-bit words of a SHA-256 digest.
WORDS = 8


def build_manifest(artefacts: DataFrame, extensions: Sequence[str] | None = None, payload: str = "content") -> DataFrame:
    """M1: SHA-256 per artefact, optionally of some extensions, sorted by path."""
    rows = artefacts
    if extensions:
        rows = rows.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*[e.lstrip(".") for e in extensions]))
    digest = F.sha2(F.col(payload), 256).alias("digest")
    return rows.select(*[c for c in rows.columns if c != payload], digest).orderBy("path")


def read_artefacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` as (path, content)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(path).select("path", "content")
    )


def fold_digests(chunks: DataFrame, fan: int = 1024, levels: int = 3) -> DataFrame:
    """M1: one tree digest per path from the digests of its chunks (``path, chunk, n_bytes, digest``): ``path, n_bytes, n_chunks, digest``.

    Up to ``fan`` digests in order are hashed together (``1:`` in front tells nodes from chunks, see ``digest_files``), ``levels`` times, then
    what is left of a path once more. So no row is larger than ``fan`` digests, and chunks of 8 MB reach 8 PB before the last step grows.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
    whole = F.sha2(F.concat(F.lit("1:"), F.array_join(ordered, "")), 256).alias("digest")
    sums = [F.sum("n_bytes").alias("n_bytes"), F.sum("n_chunks").alias("n_chunks"), whole]
    rows = chunks.select("path", "chunk", F.col("n_bytes").cast("bigint").alias("n_bytes"), F.lit(1).cast("bigint").alias("n_chunks"), "digest")
    for _ in range(levels):
        rows = rows.groupBy("path", idiv(F.col("chunk"), fan).alias("up")).agg(*sums).withColumnRenamed("up", "chunk")
    return rows.groupBy("path").agg(*sums)


def manifest_of_files(spark: SparkSession, paths: str | Sequence[str], suffix: str = "", chunk_bytes: int = 8 << 20) -> DataFrame:
    """M1: tree digests of files of any size below the given paths: ``path, n_bytes, n_chunks, digest``; no task holds more than a chunk."""
    from framekit.sources.file_chunks import digest_chunks

    return fold_digests(digest_chunks(spark, paths, suffix, chunk_bytes))


def diff_manifests(base: DataFrame, current: DataFrame, keys: Sequence[str] = ("suite", "path")) -> DataFrame:
    """M2: changed, added and removed paths."""
    a, b = base.withColumnRenamed("digest", "base_digest"), current.withColumnRenamed("digest", "current_digest")
    change = (
        F.when(F.col("base_digest").isNull(), "added").when(F.col("current_digest").isNull(), "removed").otherwise("changed")
    )
    return a.join(b, list(keys), "full").filter(~F.col("base_digest").eqNullSafe(F.col("current_digest"))).select(
        *keys, change.alias("change"), "base_digest", "current_digest"
    )


def suite_verdicts(base: DataFrame, current: DataFrame) -> DataFrame:
    """M2: PASS where a suite has no differing path, else FAIL with counts."""
    suites = base.select("suite").unionByName(current.select("suite")).distinct()
    counts = diff_manifests(base, current).groupBy("suite").agg(
        *[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("changed", "added", "removed")]
    )
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("changed", "added", "removed")]
    return suites.join(counts, "suite", "left").select(
        "suite", F.when(F.col("changed").isNull(), "PASS").otherwise("FAIL").alias("verdict"), *n
    )


def _told(field: T.StructField) -> Column:
    """A value as text that tells nulls within arrays, maps and structs from the text "null"."""
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(field.name), {"ignoreNullFields": "false"})
    return F.hex(field.name) if isinstance(field.dataType, T.BinaryType) else F.col(field.name).cast("string")


def table_digest(df: DataFrame, by: Sequence[str] = (), method: str = "xxhash64") -> DataFrame:
    """M3: order-free digest of a table's rows: their number and sums and xors of row hashes. A null counts by the column that it is in.

    ``sha2`` hashes a text of the row in which each value follows its length (null has none), so that no two rows share a text and other
    engines can repeat it; the digest's 256 bits are summed and xored as ``WORDS`` numbers of 32 bits. ``xxhash64`` is faster and has 64 bits.
    """
    cols = [c for c in df.columns if c not in by]
    if method == "xxhash64":
        plain = [F.col(c) if isinstance(df.schema[c].dataType, T.AtomicType) else _told(df.schema[c]) for c in cols]
        hashed = df.select(*by, F.xxhash64(*plain, *(F.col(c).isNull() for c in cols)).alias("__h")).groupBy(*by)
        return hashed.agg(
            F.count("*").alias("n_rows"), F.sum(F.col("__h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("__h").alias("hash_xor"),
        )
    if method != "sha2":
        raise ValueError("method is 'xxhash64' or 'sha2'")
    values = [_told(df.schema[c]) for c in cols]
    text = F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-;")) for v in values))
    hashed = df.select(*by, F.sha2(text, 256).alias("__h"))
    words = [F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(WORDS)]
    summed = hashed.select(*by, *(w.alias(f"__w{i}") for i, w in enumerate(words))).groupBy(*by).agg(
        F.count("*").alias("n_rows"), *(F.sum(f"__w{i}").alias(f"__s{i}") for i in range(WORDS)), *(F.bit_xor(f"__w{i}").alias(f"__x{i}") for i in range(WORDS)),
    )
    return summed.select(
        *by, "n_rows", F.concat_ws(",", *(F.col(f"__s{i}").cast("string") for i in range(WORDS))).alias("hash_sum"),
        F.concat_ws(",", *(F.col(f"__x{i}").cast("string") for i in range(WORDS))).alias("hash_xor"),
    )


def content_digest(samples: str = "samples") -> Column:
    """SHA-256 of a numeric array's text, nulls and their places included; that of a null array differs from all others."""
    return F.sha2(F.coalesce(F.col(samples).cast("string"), F.lit("none")), 256)


def _differences(a: str, b: str) -> Column:
    shared = F.coalesce(F.least(F.size(a), F.size(b)), F.lit(0))
    at = F.sequence(F.lit(0), shared - 1)
    return F.when(shared <= 0, F.array().cast("array<int>")).otherwise(
        F.filter(at, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    )


def capture_pairs(frames: DataFrame, keys: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Rows to compare: each capture against the lowest capture of its key, or the listed pairs.

    Equality is transitive, so one baseline per key decides whether the whole group is identical; the
    work stays linear in the rows. ``pairs`` (capture_a, capture_b, and keys if it has them) names other comparisons. A capture that shows a key several times
    counts once, by its latest ``frame_id`` where there is one. Digests (SHA-256, null samples included) of the arrays are compared first; only where they differ are
    the arrays themselves brought together (``identical`` is then false), else they are empty.
    """
    newest = F.struct(F.col("frame_id") if "frame_id" in frames.columns else F.lit(0), F.col("__h"), F.col("__n"))
    hashed = frames.select("*", content_digest().alias("__h"), F.size("samples").alias("__n"))
    shown = hashed.groupBy(*keys, "capture_id").agg(F.max(newest).alias("__top")).select(*keys, "capture_id", "__top.__h", "__top.__n")

    def side(name: str) -> DataFrame:
        return shown.withColumnsRenamed({"capture_id": f"capture_{name}", "__h": f"__h{name}", "__n": f"__n{name}"})

    if pairs is None:
        lowest = shown.groupBy(*keys).agg(F.min(F.struct(F.col("capture_id").alias("capture_a"), F.col("__h").alias("__ha"), F.col("__n").alias("__na"))).alias("__low"))
        met = side("b").join(lowest.select(*keys, "__low.*"), list(keys)).filter(F.col("capture_b") != F.col("capture_a"))
    else:
        listed = [*(k for k in keys if k in pairs.columns), "capture_a"]
        met = side("a").join(pairs, listed).join(side("b"), [*keys, "capture_b"])
    same = (F.col("__ha") == F.col("__hb")) & (F.col("__na") == F.col("__nb"))
    cols = [*keys, "capture_a", "capture_b"]
    unequal = met.filter(~same)
    wanted = unequal.select(*keys, F.explode(F.array(F.struct(F.col("capture_a").alias("c"), F.col("__ha").alias("h")), F.struct(F.col("capture_b").alias("c"), F.col("__hb").alias("h")))).alias("w"))
    wanted = wanted.select(*keys, F.col("w.c").alias("capture_id"), F.col("w.h").alias("__h")).distinct()
    held = hashed.join(wanted, [*keys, "capture_id", "__h"], "left_semi").groupBy(*keys, "capture_id", "__h").agg(F.first("samples").alias("samples"))
    for name in ("a", "b"):
        arrays = held.withColumnsRenamed({"capture_id": f"capture_{name}", "__h": f"__h{name}", "samples": f"samples_{name}"})
        unequal = unequal.join(arrays, [*keys, f"capture_{name}", f"__h{name}"])
    none = F.array().cast(frames.schema["samples"].dataType)
    equal = met.filter(same).select(*cols, none.alias("samples_a"), none.alias("samples_b"), F.lit(True).alias("identical"))
    return unequal.select(*cols, "samples_a", "samples_b", F.lit(False).alias("identical")).unionByName(equal)


def compare_captures(frames: DataFrame, keys: Sequence[str] = ("picture_number",), pairs: DataFrame | None = None) -> DataFrame:
    """M4: per compared pair: identical or not, differing samples, first difference and both values."""
    rows = capture_pairs(frames, keys, pairs).withColumn("__d", _differences("samples_a", "samples_b"))
    first = F.get("__d", F.lit(0))
    return rows.select(
        *keys, "capture_a", "capture_b", "identical", F.size("__d").alias("n_diff"),
        first.alias("first_diff"), F.get("samples_a", first).alias("value_a"), F.get("samples_b", first).alias("value_b"),
    )


def capture_classes(frames: DataFrame, keys: Sequence[str] = ("picture_number",)) -> DataFrame:
    """M4: captures of a key by equal content: ``<keys>, capture_id, class_capture, n_captures``, one row per capture.

    A class is named by its lowest capture and has ``n_captures``; any two captures are identical exactly if they have one class, so the
    verdict of every pair follows without making the pairs. A capture that shows a key several times counts by its latest ``frame_id``.
    """
    newest = F.struct(F.col("frame_id") if "frame_id" in frames.columns else F.lit(0), F.col("__h"))
    shown = frames.withColumn("__h", content_digest()).groupBy(*keys, "capture_id").agg(F.max(newest)["__h"].alias("__h"))
    classes = shown.groupBy(*keys, "__h").agg(F.min("capture_id").alias("class_capture"), F.count("*").alias("n_captures"))
    return shown.join(classes, [*keys, "__h"]).select(*keys, "capture_id", "class_capture", "n_captures")


def class_differences(frames: DataFrame, keys: Sequence[str] = ("picture_number",)) -> DataFrame:
    """M4: one row per class of ``capture_classes``, held against the key's largest class (ties: the lowest): ``<keys>, class_capture, n_captures,
    reference_capture, n_diff, first_diff, value, reference_value``. Only representatives are compared, so the work is linear in the classes."""
    classes = capture_classes(frames, keys).filter("capture_id = class_capture").drop("capture_id")
    largest = F.max_by("class_capture", F.struct("n_captures", -F.col("class_capture")))
    chosen = classes.groupBy(*keys).agg(largest.alias("reference_capture"))
    held = classes.join(chosen, list(keys))
    pairs = held.filter("class_capture <> reference_capture").select(*keys, F.col("reference_capture").alias("capture_a"), F.col("class_capture").alias("capture_b"))
    compared = compare_captures(frames, keys, pairs).select(
        *keys, F.col("capture_b").alias("class_capture"), "n_diff", "first_diff", F.col("value_b").alias("value"), F.col("value_a").alias("reference_value"),
    )
    return held.join(compared, [*keys, "class_capture"], "left").select(
        *keys, "class_capture", "n_captures", "reference_capture", F.coalesce("n_diff", F.lit(0)).alias("n_diff"), "first_diff", "value", "reference_value",
    )


def pair_verdicts(classes: DataFrame, keys: Sequence[str] = ("picture_number",)) -> DataFrame:
    """M4: of all pairs of captures of a key, how many are identical: ``<keys>, n_captures, n_classes, n_pairs, n_identical``."""
    one = classes.filter("capture_id = class_capture").groupBy(*keys).agg(
        F.sum("n_captures").alias("n_captures"), F.count("*").alias("n_classes"), F.sum(F.expr("n_captures * (n_captures - 1) div 2")).alias("n_identical"),
    )
    return one.select(*keys, "n_captures", "n_classes", F.expr("n_captures * (n_captures - 1) div 2").alias("n_pairs"), "n_identical")


def group_verdicts(compared: DataFrame, keys: Sequence[str] = ("picture_number",)) -> DataFrame:
    """M4: whether all captures of a key hold the same samples."""
    return compared.groupBy(*keys).agg(
        F.min("identical").alias("all_identical"), F.count("*").alias("n_compared"),
        F.count(F.when(~F.col("identical"), 1)).alias("n_differ"),
    )


def diff_regions(
    frames: DataFrame, samples_per_line: int, first_active: int, keys: Sequence[str] = ("picture_number",),
    pairs: DataFrame | None = None,
) -> DataFrame:
    """M5: differences of each compared pair split into blanking and active lines (0-based lines)."""
    rows = capture_pairs(frames, keys, pairs).withColumn("__d", _differences("samples_a", "samples_b"))
    edge = samples_per_line * first_active
    active = F.filter("__d", lambda i: i >= edge)
    first, first_active_at = F.get("__d", F.lit(0)), F.get(active, F.lit(0))
    return rows.select(
        *keys, "capture_a", "capture_b", F.size("__d").alias("n_diff"),
        (F.size("__d") - F.size(active)).alias("vbi_diffs"), F.size(active).alias("active_diffs"),
        idiv(first, samples_per_line).alias("first_line"), first_active_at.alias("first_active_diff"),
        idiv(first_active_at, samples_per_line).alias("first_active_line"),
    )


def phase_check(frames: DataFrame, period: int | Column) -> DataFrame:
    """M6: colour phase predicted from the frame index against the one of the picture number."""
    p = F.lit(period) if isinstance(period, int) else period
    predicted = F.pmod(F.col("frame_id"), p)
    expected = F.pmod(F.col("picture_number") - 1, p)
    return frames.select(
        *frames.columns, predicted.cast("int").alias("predicted_phase"), expected.cast("int").alias("expected_phase"),
        (predicted == expected).alias("phase_ok"),
    )


def frame_identity(source: str = "source", index: str = "source_frame_index") -> Column:
    """Stills return one image for every index, so all their frames share identity 0."""
    return F.when(F.lower(source).endswith(".exr"), 0).otherwise(F.col(index)).cast("bigint")


def duplicate_frames(frames: DataFrame, phase: str = "sequence_phase") -> DataFrame:
    """M7: uses of each (source, section_type, frame identity, phase)."""
    return frames.select(
        "source", "section_type", frame_identity().alias("identity"), F.col(phase).alias("phase")
    ).groupBy("source", "section_type", "identity", "phase").agg(F.count("*").alias("uses"))


def duplicate_summary(uses: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """M7: frames, distinct clean frames and keys used at least twice."""
    return uses.groupBy(*by).agg(
        F.sum("uses").alias("n_frames"), F.count("*").alias("n_distinct"),
        F.count(F.when(F.col("uses") >= 2, 1)).alias("n_reused"),
    )


def distinct_sketches(frames: DataFrame, by: Sequence[str] = ("source",), phase: str = "sequence_phase", size: int = 14) -> DataFrame:
    """M9: one stored sketch of distinct clean frames per group (``<by>, sketch``), so that a new capture costs only its own rows."""
    clean = _clean_frames(frames, by, phase)
    return clean.groupBy(*by).agg(F.hll_sketch_agg(F.to_json(F.struct("section_type", "identity", "phase")), size).alias("sketch"))


def _clean_frames(frames: DataFrame, by: Sequence[str], phase: str) -> DataFrame:
    """Distinct clean frames per group: a sketch counts a frame once anyway, and repeats are left out before keys are made as texts."""
    return frames.select(*by, "section_type", frame_identity().alias("identity"), F.col(phase).alias("phase")).distinct()


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """M9: distinct clean frames of coarser groups from stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_approx"))


def approx_distinct_frames(frames: DataFrame, by: Sequence[str] = ("source",), rsd: float = 0.02, phase: str = "sequence_phase") -> DataFrame:
    """M9: distinct clean frames by a sketch: one small buffer per group instead of one row per key."""
    key = F.struct("section_type", "identity", "phase")
    return _clean_frames(frames, by, phase).groupBy(*by).agg(F.approx_count_distinct(key, rsd).alias("n_distinct_approx"))


def project_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """M8: fields that differ between two configuration tables; echo fields are listed in ``ignore``."""
    def long(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c not in keys and c not in ignore]
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
        return df.select(*keys, F.explode(pairs).alias("__f")).select(
            *keys, F.col("__f.field").alias("field"), F.col("__f.value").alias(name), F.lit(True).alias(f"__has_{name}")
        )

    both = long(a, "value_a").join(long(b, "value_b"), [*keys, "field"], "full")
    change = F.when(F.col("__has_value_a").isNull(), "added").when(F.col("__has_value_b").isNull(), "removed").otherwise("changed")
    gone = F.col("__has_value_a").isNull() | F.col("__has_value_b").isNull()
    return both.filter(gone | ~F.col("value_a").eqNullSafe(F.col("value_b"))).select(
        *keys, "field", change.alias("change"), "value_a", "value_b"
    )
