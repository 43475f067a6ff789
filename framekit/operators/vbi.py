"""Code words on reserved lines: assignment, expected words, decoding, votes, continuity (V1-V8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.dims import FLAG_LENGTH_H, STOP_BIT_FRAMES, by_standard, line_rule_dim
from framekit.functions import clocks, words
from framekit.functions.scan import last_before, scan
from framekit.operators import timeline as tl

FRAME = ["capture_id", "frame_id"]

#: Missing numbers that one row stands for while pads are made.
PAD_STRETCH = 10_000


def assign_line_codes(sections: DataFrame, active_start: int = 0) -> DataFrame:
    """V1: code sent on each reserved line of a section: the first candidate that the section declares.

    ``sections``: standard, section_type, disc_type, ``code_types`` (array). The rules are one broadcast
    row per line with its candidates in order, so there is no window and no shuffle.
    """
    rules = (
        line_rule_dim(sections.sparkSession)
        .groupBy("standard", "section_type", "disc_type", "line_no")
        .agg(F.array_sort(F.collect_list(F.struct("priority", "code_type", "always", "start_h"))).alias("__cand"))
    )
    spl = by_standard("samples_per_line")
    chosen = sections.join(F.broadcast(rules), ["standard", "section_type", "disc_type"]).withColumn(
        "__pick", F.filter("__cand", lambda c: c["always"] | F.array_contains("code_types", c["code_type"]))
    ).filter(F.size("__pick") > 0)
    pick = F.get("__pick", F.lit(0))
    kind = F.when(pick["code_type"] == "fm_white_flag", "white_flag").when(
        pick["code_type"].startswith("fm_"), "fm40"
    ).otherwise("biphase24")
    return chosen.select(
        *[c for c in sections.columns if c != "code_types"], "line_no", pick["code_type"].alias("code_type"),
        kind.alias("kind"),
        F.coalesce(F.round(pick["start_h"] * spl), F.lit(active_start)).cast("int").alias("start_sample"),
        F.when(kind == "white_flag", F.round(F.lit(FLAG_LENGTH_H) * spl)).cast("int").alias("flag_length"),
    )


_STOP_BIT = 0x80000
# Fixed value: the mode digit of FM time in the programme area.
FM_MODE_PICTURE = 0xD
FM_TIME_RATE = 30


def _section_word() -> Column:
    """Word of a code that is the same on all frames of its section."""
    word = F.when(F.col("code_type") == "programme_status", F.col("status_word")).when(F.col("code_type") == "users_code", F.col("users_word"))
    for name, value in words.FIXED_WORDS.items():
        word = word.when(F.col("code_type") == name, F.lit(value))
    return word.cast("bigint")


#: Codes whose word changes from frame to frame, with the counter of the section without which they send none.
_CHANGING = {
    "picture_number": "first_picture", "chapter_number": "chapter", "programme_time_code": "first_frame", "clv_picture_number": "first_frame",
    "fm_picture_number": "fm_picture_first", "fm_programme_time": "fm_time_first",
}
_PLACE = {name: i for i, name in enumerate(_CHANGING)}


def _by_code(**values: Column) -> Column:
    """The value of the row's changing code (``__place``); null for others."""
    out = F.lit(None).cast("bigint")
    for name, value in values.items():
        out = F.when(F.col("__place") == _PLACE[name], value).otherwise(out)
    return out


def _decimal_shown() -> Column:
    """The decimal number whose digits a frame's word shows. FM time is MMSS and a place for its mode; the others' digits are those of their counter."""
    i, at = F.col("in_section"), F.col("frame_id")
    seconds = clocks.imod(clocks.idiv(F.col("fm_time_first") + i, FM_TIME_RATE), 3600)
    return _by_code(
        picture_number=F.least(F.col("first_picture") + F.col("picture_step") * i, F.col("__max_picture")),
        programme_time_code=clocks.imod(clocks.idiv(at, F.col("__per_minute")), 60), clv_picture_number=clocks.clv_frame(at),
        fm_picture_number=F.least(F.col("fm_picture_first") + i, F.lit(tl.FM_MAX).cast("bigint")),
        fm_programme_time=seconds * 10 + clocks.idiv(seconds, 60) * 400,
    )


def _frame_word(digits: Column) -> Column:
    """The word of a frame from its ``digits`` as nibbles, in field one: an FM word of the other field has one bit less."""
    at = F.col("frame_id")
    stop = F.col("chapter_frames") + F.col("chapter_step") * F.col("in_section") >= STOP_BIT_FRAMES
    hour = F.least(clocks.idiv(at, F.col("__per_minute") * 60), F.lit(15).cast("bigint"))
    fm = F.col("__place") >= _PLACE["fm_picture_number"]
    return F.when(fm, words.fm_bits(digits)).otherwise(_by_code(
        picture_number=digits + 0xF00000,
        chapter_number=F.col("__chapter_word") + F.when(stop, _STOP_BIT).otherwise(0),
        programme_time_code=digits + 0xF0DD00 + hour * 0x10000,
        clv_picture_number=words.clv_picture_word(clocks.clv_second(at), F.lit(0)) + digits,
    ))


#: The field bit of an FM word.
_FIELD_BIT = 1 << 35


def expected_words(sections: DataFrame, assignments: DataFrame | None = None, keys: Sequence[str] = ("project_id", "section_no")) -> DataFrame:
    """V2: one row per frame and assigned line with the word that must be there; codes without a value send none.

    ``sections`` carry their counters (``assign_picture_numbers``, ``chapter_state``, ``fm_state``), ``first_frame``,
    ``n_frames``, ``pass_length``, ``start_frame``, ``status_word`` and ``users_word``. Words are BIGINT: 24 bits, or the 40 bits of FM
    codes; white flags have a length instead. PAL_M has no FM codes. Without ``assignments`` the lines are assigned here (sections then have what
    ``assign_line_codes`` needs). Lines take their section's counters along and are expanded where they are, so neither
    lines nor frames are shuffled to meet each other, and a row works out its own code only.
    """
    shown = ["line_no", "code_type", "kind", "start_sample", "flag_length"]
    if assignments is None:
        lines = assign_line_codes(sections)
    else:
        lines = sections.drop("code_types").join(assignments.select(*keys, *shown), list(keys))
    sent = lines.filter((F.col("kind") != "fm40") | (F.col("standard") == "NTSC"))
    field_one = F.col("line_no") <= F.when(F.col("standard") == "PAL", 312).otherwise(262)
    less = F.when((F.col("kind") == "fm40") & ~field_one, F.lit(_FIELD_BIT)).otherwise(F.lit(0)).cast("bigint")
    place, value = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for name, counter in _CHANGING.items():
        place = F.when(F.col("code_type") == name, _PLACE[name]).otherwise(place)
        value = F.when(F.col("code_type") == name, F.col(counter)).otherwise(value)
    # what a section's frames share is worked out before they are made
    named = sent.withColumns({
        "__same": _section_word(), "__place": place, "__less": less, "__max_picture": by_standard("max_picture").cast("bigint"),
        "__per_minute": by_standard("frames_per_minute").cast("bigint"), "__chapter_word": words.chapter_word(F.col("chapter"), F.lit(0)),
    }).filter(F.col("__same").isNotNull() | value.isNotNull() | (F.col("kind") == "white_flag"))
    mode = F.when(F.col("__place") == _PLACE["fm_programme_time"], FM_MODE_PICTURE).otherwise(0)
    # columns of their own, as an expression repeats what it uses more than once
    frames = tl.expand_placed(named).withColumn("__shown", _decimal_shown()).withColumn("__digits", words.bcd(F.col("__shown"), 5) + mode)
    word = F.when(F.col("__place").isNull(), F.col("__same")).otherwise(_frame_word(F.col("__digits")) - F.col("__less"))
    return frames.select(*keys, "frame_id", "in_section", *shown, word.alias("word"))


def word_mismatches(expected: DataFrame, captured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines whose captured word is missing, unexpected or different."""
    want = expected.select(*keys, F.col("word").alias("expected_word"))
    got = captured.select(*keys, F.col("word").alias("captured_word"))
    return want.join(got, list(keys), "full").filter(
        ~F.col("expected_word").eqNullSafe(F.col("captured_word"))
    )


def decode_code_words(captured: DataFrame, word: str = "word") -> DataFrame:
    """V3: kind and fields of each captured word."""
    kind = words.code_type(F.col(word))
    typed = captured.withColumn("code_type", kind)
    fields = words.decoded_fields(F.col(word), F.col("code_type"))
    return typed.select(*typed.columns, *[c.cast("int").alias(n) for n, c in fields.items()])


def vote_frame_codes(captured: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """V4: majority word per frame and code type over its lines; ties go to the smaller word.

    Copies are counted before the vote, so the second step sees one row per distinct word.
    """
    counted = captured.withColumn("code_type", words.code_type(F.col("word"))).groupBy(
        *keys, "code_type", "word"
    ).agg(F.count("*").alias("n"))
    # a null word loses a tie against any other
    rank = F.struct(F.col("n"), F.col("word").isNotNull().alias("there"), (-F.col("word").cast("bigint")).alias("low"))
    kind = dict(captured.dtypes)["word"]
    return counted.groupBy(*keys, "code_type").agg(F.max(rank).alias("__top"), F.sum("n").alias("votes")).select(
        *keys, "code_type", (-F.col("__top.low")).cast(kind).alias("word"), "votes", F.round(F.col("__top.n") / F.col("votes"), 6).alias("agreement"),
    )


def picture_number_continuity(frames: DataFrame, key: str = "capture_id") -> DataFrame:
    """V5: step of the picture number from frame to frame: contiguous, repeat, backward_skip or forward_gap."""
    near = scan(
        frames.select(key, "frame_id", "picture_number"), [key], ["frame_id"],
        {"previous": last_before(F.col("picture_number"))},
    )
    return near.select(key, "frame_id", "picture_number", "previous", *step_class(F.col("picture_number") - F.col("previous")))


def step_class(step: Column) -> list[Column]:
    """Class of a picture number step and the numbers that a forward gap leaves out."""
    return [
        F.when(step.isNull(), "start").when(step == 1, "contiguous").when(step == 0, "repeat")
        .when(step < 0, "backward_skip").otherwise("forward_gap").alias("step_class"),
        F.when(step > 1, step - 1).otherwise(0).cast("bigint").alias("missing"),
    ]


def frame_map(frames: DataFrame, key: str = "capture_id") -> DataFrame:
    """V6: one frame per picture number (the latest pass), and a pad row (frame null) per missing number.

    Frames without a number are one row per capture with a null number. Missing numbers come from ``number_gaps``, in stretches of at most
    ``PAD_STRETCH``, so that no row holds a long list; with numbers that are not bounded, ask for the gaps alone.
    """
    kept = _passes(frames, key)
    gaps = _gaps(kept, key)
    starts = F.sequence(F.col("first_number"), F.col("last_number"), F.lit(PAD_STRETCH).cast("bigint"))
    stretches = gaps.select(key, "last_number", F.explode(starts).alias("__from"))
    pads = stretches.select(key, F.explode(F.sequence("__from", F.least(F.col("__from") + PAD_STRETCH - 1, "last_number"))).alias("picture_number"))
    shown = kept.select(key, "picture_number", "frame_id", "passes", F.lit(False).alias("is_pad"))
    kind = dict(kept.dtypes)
    return shown.unionByName(pads.select(
        key, F.col("picture_number").cast(kind["picture_number"]).alias("picture_number"), F.lit(None).cast(kind["frame_id"]).alias("frame_id"),
        F.lit(0).cast("bigint").alias("passes"), F.lit(True).alias("is_pad"),
    ))


def _passes(frames: DataFrame, key: str) -> DataFrame:
    return frames.groupBy(key, "picture_number").agg(F.max("frame_id").alias("frame_id"), F.count("*").alias("passes"))


def _gaps(kept: DataFrame, key: str) -> DataFrame:
    near = scan(
        kept.filter("picture_number is not null").select(key, F.col("picture_number").cast("bigint").alias("picture_number")), [key], ["picture_number"],
        {"previous": last_before(F.col("picture_number"))},
    )
    return near.filter("picture_number > previous + 1").select(
        key, (F.col("previous") + 1).alias("first_number"), (F.col("picture_number") - 1).alias("last_number"),
    )


def number_gaps(frames: DataFrame, key: str = "capture_id") -> DataFrame:
    """V6: missing picture numbers as ranges, however long: ``<key>, first_number, last_number, n_missing``."""
    return _gaps(_passes(frames, key), key).withColumn("n_missing", F.col("last_number") - F.col("first_number") + 1)


def verify_checksums(rows: DataFrame, kind: str) -> DataFrame:
    """V7: add ``check_ok``: Hamming nibble of status words, parity of FM words, or CRC of Q payloads.

    ``kind`` is 'status' (``word``), 'fm' (``fm_word`` BIGINT) or 'q' (``payload`` array of bytes, ``crc``).
    """
    checks = {
        "status": lambda: words.hamming_ok(F.col("word")),
        "fm": lambda: words.fm_parity_ok(F.col("fm_word")),
        "q": lambda: words.q_crc(F.col("payload")) == F.col("crc"),
    }
    return rows.withColumn("check_ok", checks[kind]())


def code_coverage(captured: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """V8: frames that carry each code type, and the share of words with a valid key bit.

    Words are counted per frame first; the distinct count of frames needs no second pass.
    """
    typed = captured.withColumn("code_type", words.code_type(F.col("word")))
    frames = typed.groupBy(*keys, "frame_id", "code_type").agg(
        F.count("*").alias("n"), F.sum(words.key_ok(F.col("word")).cast("bigint")).alias("ok")
    )
    return frames.groupBy(*keys, "code_type").agg(
        F.count("*").alias("n_frames"), F.sum("n").alias("n_words"),
        F.round(F.sum("ok") * 100.0 / F.sum("n"), 6).alias("key_ok_percent"),
    )
