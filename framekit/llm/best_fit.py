"""Packing whole documents into as few sequences as possible: dominated choices are fixed first, the rest goes by best fit.

Each document, followed by an end id, is one item; a longer one than ``capacity`` is cut into full pieces and one shorter first piece. A full
piece is a sequence of its own. The other items have at most ``capacity - 1`` different lengths, so the whole packing is a plan over a table
of lengths and their counts, which never has more rows than that, whatever the input's size. The plan is made of that table on the driver:

1. Reduction by dominance, after Martello and Toth: for the longest length down, if a set of at most three items with it dominates every
   other set that would fit with it (for each other set, its items can be replaced by those of this one, each at least as long as the ones it replaces), then
   some best packing has it as a sequence, and it is fixed as often as its counts allow; that shrinks the table, and goes on until nothing is found.
2. Best fit, longest first, for what remains.

Documents do not move between tasks. The first pass encodes texts and numbers the items of one length within its task; a table of counts per
(task, length) tells how many come before; the second pass looks the item's number up in the plan, which gives sequence and offset.

Rows: one per piece, ``<id column>, piece, start, length, sequence_id, offset, ids``. Sequences of full pieces have negative numbers. Every id lies
in exactly one piece.

Null texts are empty texts; an empty text is its end id alone. Null and repeated ids stay, one document per row. An empty table gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import long_texts, slices, small
from framekit.llm.packing import _byte_signs as byte_signs
from framekit.session import cut

CAPACITY, END_ID = 2048, 0
#: Fixed value: how byte-level tokenizers split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of more signs are left to the library whose time grows slowest with their length. It changes speed only.
LONG_RUN = 5_000
#: Tasks of the first pass whose counts (one row of ``capacity`` numbers each) may be broadcast.
BROADCAST_PARTS = 1_000
_PER_PROCESS: dict[tuple[str, str], TextEncoder] = {}
Pattern = tuple[tuple[int, int], ...]


class TextEncoder:
    """Ids of whole texts by a tokenizer file.

    A plain byte-level file (no normaliser, the usual split pattern, merges in the order of their ids) is read as ranks, which gives the same ids in less time;
    other files, and texts with a very long run of signs or of white space, go through the file's own library.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.ranks = self._ranks(told, pattern)

    def _ranks(self, told: dict, pattern: str):
        """The same encoder from ranks, None where the file is of another kind."""
        split, model = told["pre_tokenizer"] or {}, told["model"]
        plain = told["normalizer"] is None and told["post_processor"] is None and model["type"] == "BPE" and (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        ) and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            return None
        merges = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merges != sorted(merges) or len(merges) + 256 != len(model["vocab"].keys() - self.special.keys()):
            return None
        import tiktoken

        byte_of = {sign: b for b, sign in enumerate(byte_signs())}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in self.special}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> list[int]:
        if self.ranks is None or len(text) > LONG_RUN and self._has_long_run(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode(text, allowed_special="all")

    @staticmethod
    def _has_long_run(text: str) -> bool:
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) > LONG_RUN or len(text) - sum(sizes) - len(sizes) > LONG_RUN


def text_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """The encoder of this Python process."""
    if (path, pattern) not in _PER_PROCESS:
        _PER_PROCESS[path, pattern] = TextEncoder(path, pattern)
    return _PER_PROCESS[path, pattern]


class Counts:
    """How many items of each length there are, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.of = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.of)

    def take(self, size: int, n: int = 1) -> None:
        self.of[size] -= n
        if not self.of[size]:
            del self.of[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def put(self, size: int) -> None:
        if size not in self.of:
            self.of[size] = 0
            insort(self.sizes, size)
        self.of[size] += 1

    def largest(self, room: int) -> int:
        """The longest length that fits, 0 if none."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The ``k`` shortest items longer than ``above`` (fewer, if there are fewer)."""
        found: list[int] = []
        for at in range(bisect_right(self.sizes, above), len(self.sizes)):
            size = self.sizes[at]
            found += [size] * min(self.of[size], k - len(found))
            if len(found) == k:
                break
        return found

    def best_pair(self, room: int) -> int:
        """The largest sum of two items that is at most ``room``, 0 if none."""
        low, high, best = 0, bisect_right(self.sizes, room) - 1, 0
        while low <= high:
            total = self.sizes[low] + self.sizes[high]
            if total > room or low == high and self.of[self.sizes[low]] < 2:
                high -= 1
            else:
                best = max(best, total)
                low += 1
        return best


def dominating(others: Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """The items that, with one of ``size``, dominate all sets that fit with it among ``others``; None if no such set is known."""
    room = capacity - size
    star = others.largest(room)
    if not star:
        return ()
    least = others.smallest(3)
    if star == room or sum(least[:2]) > room or len(least) < 2:
        return (star,)
    if len(least) == 3 and sum(least) <= room:
        return None  # four items fit
    if others.best_pair(room) <= star:
        return (star,)
    others.take(star)
    second = others.largest(room - star)
    others.put(star)
    if second:
        longer = others.smallest(2, second)
        if len(longer) < 2 or sum(longer) > room:
            return (star, second)  # no pair that fits has both items longer than the second
    return None


def reduce_by_dominance(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, taking their items out of ``counts``; returns the patterns with how often each is a sequence."""
    fixed: list[tuple[Pattern, int]] = []
    found = True
    while found:
        found = False
        for size in sorted(counts.of, reverse=True):
            while size in counts.of:
                counts.take(size)
                others = dominating(counts, size, capacity)
                counts.put(size)
                if others is None:
                    break
                wanted: dict[int, int] = {}
                for s in (size, *others):
                    wanted[s] = wanted.get(s, 0) + 1
                times = min(counts.of[s] // k for s, k in wanted.items())
                for s, k in wanted.items():
                    counts.take(s, k * times)
                fixed.append((tuple(wanted.items()), times))
                found = True
    return fixed


def fit_best(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit of all items, longest first; equal open sequences are handled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, times))

    for size in reversed(counts.sizes):
        left = counts.of[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            each = room // size
            full = min(times, left // each)
            put(room - each * size, (*pattern, (size, each)), full)
            left -= full * each
            if full < times and left:
                put(room - left * size, (*pattern, (size, left)), 1)
                left, full = 0, full + 1
            if pattern:
                put(room, pattern, times - full)
    return [found for group in open_.values() for found in group]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length its stretches: first number, first sequence, items a sequence, offset; sorted by first number."""
    table = Counts(counts)
    given, sequence, stretches = dict.fromkeys(table.of, 0), 0, {s: [] for s in table.of}
    for pattern, times in [*reduce_by_dominance(table, capacity), *fit_best(table, capacity)]:
        offset = 0
        for size, each in pattern:
            stretches[size].append((given[size], sequence, each, offset))
            given[size] += each * times
            offset += each * size
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in stretches.items()}


def encode(docs: DataFrame, tokenizer: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """First pass: ``part, <id column>, rest, nth, full_before, ids``.

    ``rest`` is the length of the item that is no full piece (0 if there is none), ``nth`` counts earlier ones of that length in the same
    task, and ``full_before`` earlier full pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, to_ids = TaskContext.get().partitionId(), text_encoder(tokenizer, pattern)
        met, full = [0] * capacity, 0
        for batch in slices(batches):
            ids = [array("i", [*to_ids(text or ""), end_id]) for text in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rests, nth = (sizes % capacity).tolist(), []
            for rest in rests:
                nth.append(met[rest])
                met[rest] += 1
            fulls = sizes // capacity
            before = full + np.cumsum(fulls) - fulls
            full += int(fulls.sum())
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(rests, pa.int32()), pa.array(nth, pa.int64()), pa.array(before),
                 pa.ListArray.from_arrays(edges, flat)],
                names=["part", id_col, "rest", "nth", "full_before", "ids"],
            )

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("rest", T.IntegerType()),
        T.StructField("nth", T.LongType()), T.StructField("full_before", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])
    return long_texts(docs).select(id_col, text_col).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pattern: str = PATTERN,
) -> DataFrame:
    """Pieces of all documents; see the module's text."""
    encoded = cut(encode(docs, tokenizer, pattern, id_col, text_col, capacity, end_id), "encoded")
    counts = cut(encoded.groupBy("part", "rest").count(), "lengths")
    totals = counts.filter("rest > 0").groupBy("rest").agg(F.sum("count").alias("n")).collect()  # fewer rows than capacity
    stretches = plan({r["rest"]: r["n"] for r in totals}, capacity)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_length = counts.select("part", "rest", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    def as_row(rows: pd.DataFrame) -> pd.DataFrame:
        before = np.zeros(capacity, np.int64)
        before[rows["rest"].to_numpy()] = rows["before"].to_numpy()
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "before": [before]})

    parts = cut(per_length.groupBy("part").applyInPandas(as_row, "part int, before array<long>"), "before")
    placed = encoded.join(small(parts, BROADCAST_PARTS), "part").select(
        id_col, "rest", (F.get("before", F.col("rest")) + F.col("nth")).alias("number"),
        (F.lit(-1).cast("long") - F.shiftleft(F.col("part").cast("long"), 40) - F.col("full_before")).alias("full"), "ids",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(4)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            rests, numbers, fulls = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "sequence_id", "offset", "ids")}
            for row, (rest, number, full) in enumerate(zip(rests, numbers, fulls, strict=True)):
                first, n = int(edges[row]), int(edges[row + 1] - edges[row])
                start = piece = 0
                while start < n:
                    if rest and not piece:
                        own = stretches[rest]
                        begin, sequence, each, offset = own[np.searchsorted(own[:, 0], number, "right") - 1].tolist()
                        length, sequence, offset = rest, sequence + (number - begin) // each, offset + (number - begin) % each * rest
                    else:
                        length, sequence, offset, full = capacity, full, 0, full - 1
                    ids = flat[first + start : first + start + length].astype("<u4").tobytes()
                    for name, value in zip(rows, (row, piece, start, length, sequence, offset, ids), strict=True):
                        rows[name].append(value)
                    start, piece = start + length, piece + 1
            owner = batch.column(0).take(pa.array(rows.pop("row"), pa.int64()))
            pieces, numbers_ = pa.array(rows.pop("ids"), pa.binary()), pa.array(rows.pop("piece"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [owner, numbers_, *(pa.array(v, pa.int64()) for v in rows.values()), pieces], names=[id_col, "piece", *rows, "ids"],
            )

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        *(T.StructField(k, T.LongType()) for k in ("start", "length", "sequence_id", "offset")), T.StructField("ids", T.BinaryType()),
    ])
    return placed.mapInArrow(run, schema)
