"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found over a dictionary of trie-node pairs.

Words are sorted, and the nodes of their trie are numbered: each task scans a sorted range of words, and nodes that a range shares with the
one before it take the numbers from there (only the last word of each range goes to the driver for that: as many rows as the sort has partitions). The same
is done with the reversed words. A word without its letter ``i`` is then a pair of integers, the node of what stands before it and the reverse
node of what stands behind it; a word cut at ``i`` without skipping a letter is such a pair as well. Two words meet in a pair

- with both skipping a letter: they differ by a replaced letter, or
- with one skipping a letter and the other just cut: the first has one letter more. Within a run of equal letters only its first is skipped
  for this, so that two words meet once.

All words of a pair are one known string with one letter more or less, so a pair holds at most as many words as there are letters, plus
one. There is no hot pair, no candidate is false, and none is missed.

A word's form is its near word of largest count (ties: smallest in code-point order), where that is at least ``RATIO`` times the word's own.
Counts grow along forms, so following them ends; that is done by pointer doubling.

Null texts hold no words; a null id counts as an empty one in the hash of ``count_words``. Repeated documents count as often as they
stand. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import long_texts, slices, small
from framekit.session import cut

LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: One in so many runs loses a letter when ``count_words`` is asked to (the test of the method).
LOSSY = 97
#: Words that a task counts before it hands the counts on; they are summed after a shuffle.
COUNTED = 100_000
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Kinds of a word's pairs: a letter skipped (the first of equal letters, a later one), only cut.
SKIP, SKIP_AGAIN, CUT = 0, 1, 2


def runs_of(text: str) -> list[str]:
    """Runs of letters, with A-Z in lower case."""
    return LETTERS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def lossy(doc_id: object, run: str, every: int) -> str:
    """The run, without one of its letters where the hash of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lossy_every: int | None = None) -> DataFrame:
    """``word, n``: runs of at least ``LEAST_LETTERS`` letters and how often they stand in all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(runs_of(text or ""))
                if lossy_every:
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in counts.items():
                        if zlib.crc32(word.encode(), seed) % lossy_every == 0:
                            word = lossy(doc_id, word, lossy_every)
                        if len(word) >= LEAST_LETTERS:
                            total[word] += n
                else:
                    for word, n in counts.items():
                        if len(word) >= LEAST_LETTERS:
                            total[word] += n
            if len(total) >= COUNTED:
                yield handed()
                total.clear()
        yield handed()

    found = long_texts(docs).select(id_col, text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def trie_nodes(words: DataFrame, col: str) -> DataFrame:
    """``col, place, nodes`` for distinct words: the place in code-point order, and the number of the trie node of each of its beginnings.

    Node 0 is the root; numbers are the same for the same beginning only. Places and numbers ascend but have gaps.
    """
    ordered = words.select(col).repartitionByRange(col).sortWithinPartitions(col)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, path, made, place = TaskContext.get().partitionId(), "", [], 0, 0
        for batch in slices(batches):
            found = batch.column(0).to_pylist()
            paths, totals = [], []
            for word in found:
                shared = len(commonprefix([last, word]))
                new = len(word) - shared
                path = [*path[:shared], *range(made + 1, made + new + 1)]
                made, last = made + new, word
                paths.append(path)
                totals.append(made)
            places = list(range(place, place + len(found)))
            place += len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(found), pa.int32()), pa.array(places, pa.int64()), batch.column(0), pa.array(paths, pa.list_(pa.int64())), pa.array(totals, pa.int64())],
                names=["part", "place", col, "nodes", "made"],
            )

    scanned = cut(ordered.mapInArrow(scan, f"part int, place long, {col} string, nodes array<long>, made long"), "trie")
    # one row per partition of the sort: its last word, with the nodes that it has
    ends = scanned.groupBy("part").agg(F.max_by(F.struct(col, "nodes", "made"), "place").alias("end"), F.count("*").alias("n")).collect()
    before: dict[int, tuple[int, int, str, list[int]]] = {}
    base, place, last, path = 0, 0, "", []
    for row in sorted(ends, key=lambda r: r["part"]):
        before[row["part"]] = (base, place, last, path)
        word, nodes, made = row["end"]
        shared = len(commonprefix([last, word]))
        last, path = word, [*path[:shared], *(base + x for x in nodes[shared:])]
        base, place = base + made, place + row["n"]

    def renumber(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, paths = [], []
            for part, at, word, nodes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                base, first, last, path = before[part]
                shared = len(commonprefix([last, word]))
                places.append(first + at)
                paths.append([*path[:shared], *(base + x for x in nodes[shared:])])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=[col, "place", "nodes"])

    return scanned.mapInArrow(renumber, f"{col} string, place long, nodes array<long>")


def node_pairs(words: DataFrame) -> DataFrame:
    """``before, behind, kind, place, n``: the pairs of each word. ``words`` has ``word, n, place, nodes, back`` (reverse nodes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            before: list[int] = []
            behind: list[int] = []
            kinds: list[int] = []
            sizes: list[int] = []
            for word, nodes, back in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size, head, tail = len(word), [0, *nodes], [*reversed(back), 0]
                before += head[:-1]
                behind += tail[1:]
                kinds += [SKIP if i == 0 or word[i] != word[i - 1] else SKIP_AGAIN for i in range(size)]
                before += head
                behind += tail
                kinds += [CUT] * (size + 1)
                sizes.append(2 * size + 1)
            rows = pa.array([r for r, size in enumerate(sizes) for _ in range(size)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(before, pa.int64()), pa.array(behind, pa.int64()), pa.array(kinds, pa.int32()), batch.column(3).take(rows), batch.column(4).take(rows)],
                names=["before", "behind", "kind", "place", "n"],
            )

    return words.select("word", "nodes", "back", "place", "n").mapInArrow(run, "before long, behind long, kind int, place long, n long")


def near_words(words: DataFrame) -> DataFrame:
    """``word, place, n, n_near, best``: how many words differ by one letter, and the best of these as ``struct(minus n, place)``.

    ``words`` has distinct ``word``, and ``n``.
    """
    words = words.select("word", "n")
    forward = trie_nodes(words, "word")
    backward = trie_nodes(words.select(F.reverse("word").alias("turned")), "turned").select(F.reverse("turned").alias("word"), F.col("nodes").alias("back"))
    numbered = cut(words.join(forward, "word").join(backward, "word"), "numbered")
    member = F.struct((-F.col("n")).alias("minus_n"), "place", "kind")
    # at most one word of each letter in a pair, and one that is cut there
    groups = node_pairs(numbered).groupBy("before", "behind").agg(F.array_sort(F.collect_list(member)).alias("met")).filter(F.size("met") > 1)

    def others(m):
        return F.filter("met", lambda o: (o["place"] != m["place"]) & F.when(m["kind"] == CUT, o["kind"] == SKIP).when(
            o["kind"] == CUT, m["kind"] == SKIP).otherwise(F.lit(True)))

    found = groups.select(F.inline(F.transform("met", lambda m: F.struct(m["place"].alias("place"), others(m).alias("near")))))
    best = F.col("near")[0]
    found = found.filter(F.size("near") > 0).groupBy("place").agg(
        F.sum(F.size("near")).alias("n_near"), F.min(F.struct(best["minus_n"].alias("minus_n"), best["place"].alias("place"))).alias("best"),
    )
    return numbered.select("word", "place", "n").join(found, "place", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))


def follow(forms: DataFrame) -> DataFrame:
    """``place, root`` for rows ``place, form`` (a forest): the end of each path, by pointer doubling."""
    now = cut(forms.select("place", F.col("form").alias("root")), "pointers")
    while True:
        jump = now.select(F.col("place").alias("root"), F.col("root").alias("beyond"))
        following = cut(now.join(jump, "root", "left").select("place", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "pointers")
        now = following.select("place", "root")
        if not following.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of ``word, n`` that occur at least ``least_count`` times."""
    known = cut(words.filter(F.col("n") >= least_count), "words")
    met = cut(near_words(known), "near")
    chosen = met.filter(-F.col("best.minus_n") >= ratio * F.col("n"))
    forms = chosen.select("place", F.col("best.place").alias("form"), (-F.col("best.minus_n")).alias("form_n"))
    roots = follow(forms)
    names = met.select("place", "word")
    named = forms.join(roots, "place").join(names.select(F.col("place").alias("form"), F.col("word").alias("form_word")), "form").join(
        names.select(F.col("place").alias("root"), F.col("word").alias("root_word")), "root",
    ).select("place", "form_word", "root_word", "form_n")
    return met.join(small(named), "place", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n",
    )
