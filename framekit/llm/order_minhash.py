"""Order MinHash fingerprints, whose likeness follows edit distance: they notice moved passages, which plain sets do not.

The letters of a text are its units, each with the white space behind it: a word of at most ``WORD`` signs is one unit, and of a longer run
without white space each sign is one (but for the run's last ``WORD`` signs, which are one together). So an edit moves no unit beyond its own word, and in
texts without white space a k-mer starts at every sign. A k-mer is ``K`` units in a row (fewer at the end); each unit is hashed once, and a
k-mer's hash is made of its units'. The k-mers are numbered by occurrence, so that a repeated passage counts as often as it stands, and each pair (k-mer,
occurrence) is hashed. The hash's upper bits deal the pairs into ``2 ** BIN_BITS`` sketches; each sketch takes the ``TUPLE`` smallest, puts
their k-mers back into the order of the text, and hashes that tuple. The fingerprint is the list of sketches with their tuple hashes; the
likeness of two fingerprints is the share of equal sketches among those that either has.

All of it is array functions on one row, without shuffles: two sorts of packed numbers per text, so time grows as n log n.

A null text is empty; a text without signs has an empty fingerprint. Two empty fingerprints have likeness 1, an empty and another one 0.
Equal texts have equal fingerprints. The new columns replace those of the same names; all others and all rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framekit.llm.common import small

K = 4
TUPLE = 2
BIN_BITS = 6
WORD = 12
UNIT = rf"\S{{1,{WORD}}}+(?!\S)\s*+|\S\s*+"
#: Ids to a block when documents are put in order; a halo row of each block goes to the one before.
ORDER_BITS = 9
#: Blocks whose order one task may find; more are ordered in blocks again.
TOP_BLOCKS = 100_000


def _low(bits: Column) -> Column:
    """A mask of that many low bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def with_sketches(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with an array column ``out``: for each sketch that has any k-mer, its number and its tuple hash as hexadecimal text."""
    units, hashes, bits, ranked, picked = (f"__{out}_{x}" for x in ("units", "hashes", "bits", "ranked", "picked"))
    found = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(UNIT), 0)
    step = df.withColumn(units, F.transform(found, lambda x: F.xxhash64(x)))
    # a hash leaves out nulls, so that the last k-mers are shorter
    step = step.withColumn(hashes, F.transform(units, lambda x, i: F.xxhash64(x, *(F.get(F.col(units), i + j) for j in range(1, K)))))
    step = step.withColumn(bits, F.length(F.bin(F.size(hashes))).cast("int"))
    b = F.col(bits)
    # k-mers sorted by hash, each with its place in the low bits
    step = step.withColumn(ranked, F.sort_array(F.transform(hashes, lambda h, i: _left(h, b).bitwiseOR(i.cast("long")))))
    rows = F.col(ranked)

    def occurrence(x: Column, j: Column) -> Column:
        """How many of the k-mers up to this place in ``ranked`` are this one; long runs by a binary search for the run's start."""
        own = _right(x, b)

        def start() -> Column:
            steps = F.sequence(b, F.lit(0), F.lit(-1))
            return F.aggregate(steps, F.lit(-1), lambda p, k: F.when(
                (p + _left(F.lit(1), k) < j) & (F.get(rows, p + _left(F.lit(1), k)) < _left(own, b)), p + _left(F.lit(1), k),
            ).otherwise(p))

        def same(back: int) -> Column:
            return _right(F.get(rows, j - back), b) == own

        return F.when((j < 1) | ~same(1), F.lit(1)).when((j < 2) | ~same(2), F.lit(2)).otherwise(j - start())

    numbered = F.transform(rows, lambda x, j: F.xxhash64(_right(x, b).bitwiseAND(F.lit(0xFFFFFFFF)), occurrence(x, j)).bitwiseAND(F.bitwise_not(_low(b))).bitwiseOR(x.bitwiseAND(_low(b))))
    step = step.withColumn(picked, F.sort_array(numbered))
    least = F.filter(picked, lambda y, j: (j < TUPLE) | (_bin(F.get(F.col(picked), j - TUPLE)) != _bin(y)))
    step = step.withColumn(picked, least)
    chosen = F.col(picked)

    def entry(y: Column, j: Column) -> Column:
        own = F.filter(F.slice(chosen, j + 1, TUPLE), lambda z: _bin(z) == _bin(y))
        places = F.sort_array(F.transform(own, lambda z: z.bitwiseAND(_low(b))))
        tuple_hash = F.xxhash64(F.transform(places, lambda p: F.get(F.col(hashes), p.cast("int"))))
        text = F.concat(F.lpad(F.hex(_bin(y)), 2, "0"), F.lpad(F.hex(tuple_hash), 16, "0"))
        return F.when((j < 1) | (_bin(F.get(chosen, j - 1)) != _bin(y)), text)

    return step.withColumn(out, F.array_compact(F.transform(chosen, entry))).drop(units, hashes, bits, ranked, picked)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either list has, from 0 to 1."""
    def numbers(x: Column) -> Column:
        return F.transform(x, lambda e: F.substring(e, 1, 2))

    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint as one text."""
    return with_sketches(df, text_col, out).withColumn(out, F.array_join(out, "-"))


def following(keys: DataFrame) -> DataFrame:
    """``key, next`` for a table of distinct numbers ``key``; the largest has a null ``next``."""
    if keys.limit(TOP_BLOCKS + 1).count() <= TOP_BLOCKS:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    blocked = keys.withColumn("block", F.shiftright("key", ORDER_BITS))
    within = blocked.withColumn("next", F.lead("key").over(Window.partitionBy("block").orderBy("key")))
    firsts = blocked.groupBy("block").agg(F.min("key").alias("first"))
    after = following(firsts.select(F.col("block").alias("key"))).select(F.col("key").alias("block"), F.col("next").alias("next_block"))
    after = after.join(firsts.select(F.col("block").alias("next_block"), "first"), "next_block", "left").select("block", "first")
    return within.join(after, "block").select("key", F.coalesce("next", "first").alias("next"))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next document in ascending id (ties by the columns given), after the last that of the first.

    Documents are dealt by blocks of ``2 ** ORDER_BITS`` ids; the first document of each block is also sent to the block before it.
    """
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__block", F.shiftright("__key", ORDER_BITS))
    firsts = keyed.groupBy("__block").agg(F.min("__key").alias("first"))
    after = following(firsts.select(F.col("__block").alias("key")))
    ends = firsts.agg(F.min("__block").alias("low"), F.max("__block").alias("high"))
    halo = after.join(firsts, after["next"] == firsts["__block"]).select(F.col("key").alias("to"), F.col("first"), F.lit(0).alias("turn")).union(
        ends.join(firsts, F.col("low") == F.col("__block")).select(F.col("high").alias("to"), "first", F.lit(1).alias("turn")),
    )
    copied = keyed.join(small(halo), F.col("__key") == F.col("first")).select(
        *docs.columns, "__key", F.col("to").alias("__block"), F.col("turn").alias("__turn"), F.lit(True).alias("__halo"),
    )
    rows = keyed.withColumns({"__turn": F.lit(0), "__halo": F.lit(False)}).select(*docs.columns, "__key", "__block", "__turn", "__halo").union(copied)
    order = Window.partitionBy("__block").orderBy("__turn", "__key", *columns)
    led = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.filter(~F.col("__halo")).drop("__key", "__block", "__turn", "__halo")
