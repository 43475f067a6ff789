"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor goes through the parts in order and writes text escaped, and each
other part as a placeholder of its type; it records where each attachment stands, its reference and how many tokens the placeholder will
expand to. Turns are written as ``<|im_start|>role\\n content <|im_end|>\\n`` (without the blanks) in the order of turns.

Inside texts and roles every ``<`` that is followed by any number of ``!`` and then ``|`` gets one more ``!``; hence no control string can
occur there, and taking one ``!`` away again restores the text. In roles, line breaks and backslashes are written as ``\\n`` and ``\\\\``.

A conversation is one row of the result, as is its nature; turns are formatted before they are brought together, so that only their text moves.
Null texts, null parts and null lists are empty; a null role is an empty one. Equal turn numbers are ordered by role, then content; repeated
rows are repeated turns. A null conversation id is a conversation of its own. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens: an image has one for each tile of this many pixels squared, audio so many a second, a document so many a page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
ATTACHMENTS = "array<struct<type:string,ref:string,at:bigint,tokens:bigint>>"
ATTACHMENT_TYPES = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", r"<$1|")


def _write_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _read_role(written: Column) -> Column:
    # between two escaped backslashes there are only escaped line breaks
    pieces = F.split(unescape(written), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; unknown sizes count as one unit."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    return (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0)).cast("long")
    )


def visit(part: Column) -> Column:
    """What one part writes: escaped text, or the placeholder of an attachment."""
    kind = part["type"]
    return F.when(kind.isin(*ATTACHMENT_TYPES), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_turns(turns: DataFrame, parts_col: str = "parts") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, content, attachments``.

    ``attachments`` lists ``type, ref, at, tokens``, where ``at`` counts the characters of the content before the placeholder.
    """
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(PARTS)), lambda p: p.isNotNull())
    def step(seen: Column, part: Column) -> Column:
        written = visit(part)
        attached = part["type"].isin(*ATTACHMENT_TYPES)
        # what would become a control string only across the border of two text parts is escaped as in one text
        before = F.when(~attached & written.rlike(r"\A!*\|"), F.regexp_replace(seen["content"], r"<(!*)\z", r"<!$1")).otherwise(seen["content"])
        entry = F.struct(
            part["type"].alias("type"), part["ref"].alias("ref"), F.length(seen["content"]).cast("long").alias("at"), expanded_tokens(part).alias("tokens"),
        )
        return F.struct(
            F.concat(before, written).alias("content"),
            F.when(attached, F.concat(seen["attachments"], F.array(entry))).otherwise(seen["attachments"]).alias("attachments"),
        )

    walked = F.aggregate(parts, F.struct(F.lit("").alias("content"), F.array().cast(ATTACHMENTS).alias("attachments")), step)
    return turns.select("conv_id", "turn", "role", walked.alias("w")).select("conv_id", "turn", "role", "w.content", "w.attachments")


def format_chats(turns: DataFrame, parts_col: str = "parts", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are (start, end) in code points of the content of the trained role's turns, in order. ``attachments`` are as in
    ``format_turns``, with ``at`` counted from the start of the conversation.
    """
    heads = format_turns(turns, parts_col).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "content", "attachments",
        F.concat(F.lit(START), _write_role(F.col("role")), F.lit("\n")).alias("head"),
    )
    size = F.length("head") + F.length("content") + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = heads.withColumn("start", F.sum(size).over(order) - size)
    turn = F.struct("start", (F.col("role") == trained_role).alias("trained"), "head", "content", "attachments")
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def body(t: Column) -> Column:
        return t["start"] + F.length(t["head"])

    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
        a["type"].alias("type"), a["ref"].alias("ref"), (body(t) + a["at"]).alias("at"), a["tokens"].alias("tokens"),
    ))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(
            body(t).alias("start"), (body(t) + F.length(t["content"])).alias("end"),
        )).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text); placeholders of attachments stay in the text as they are."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.filter(blocks, lambda b: b != ""),
        lambda b: F.struct(
            _read_role(F.substring_index(F.substring(b, len(START) + 1, 2147483647), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(b, r"(?s)\A<\|im_start\|>[^\n]*\n", "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
