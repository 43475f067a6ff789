"""Join of documents on the Jaccard likeness of their word shingles, by signature trees.

A document's set holds its distinct shingles of ``WIDTH`` words (A-Z in lower case, cut at ASCII white space); with fewer words the whole
sequence is one shingle. Two documents link when ``100 * |A and B| >= LIKENESS * |A or B|``. The join is exact but for 64-bit hashes
standing for shingles and sets.

1. Documents of equal sets are one node.
2. Nodes that may link are brought together by a two-step prefix filter. Two linked sets share at least ``t`` of their first
   ``|A| - need + t`` shingles in the order of hashes. Of these, the rarest suffice again: all but ``t - 1`` of them, in the order of how many
   nodes hold them. Shingles held by one node drop out, so an unlike document is left alone. Nodes that share a remaining shingle fall
   into one group (connected components, in Spark).
3. A group's sets meet in one task, where a signature tree is built: documents in order of size are leaves; a tree node holds the OR of
   their token bitmaps, their range of sizes and the largest number of tokens hidden by equal bits. Pairs of tree nodes are traversed
   together and dropped when sizes or the largest possible overlap rule out a link, or all below them is linked already. Pairs of documents
   that remain are compared exactly. Groups of more than ``BLOCK`` nodes are cut into blocks, a task for each pair of blocks.
4. Each task gives the links that it needed to connect its documents; components of all of them give the classes.

Nothing is capped. Only links that connect classes are made, not all pairs of a class.

A null or empty text has an empty set and links with nothing; it is a class of its own. Repeated rows, and repeated or null ids, keep
their rows. The class id is the smallest id of its documents. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import long_texts, small
from framekit.llm.components import components
from framekit.session import cut

WIDTH = 5
#: Hundredths of the union that two linked sets share at least.
LIKENESS = 75
#: Hundredths of a set by which the first prefix is longer than it must be.
LONGER = 15
#: Nodes that a task compares with each other at most, and documents in a leaf and children of a node of the tree.
BLOCK, LEAF, FAN = 4096, 16, 4
#: Bytes of text that are hashed together, and nodes that a task remembers to emit each once; they change speed only.
CHUNK_BYTES, REMEMBERED = 1 << 20, 300_000

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
# odd numbers: the base of word hashes, the places of a shingle, and the mixing
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = np.cumprod(np.full(WIDTH + 1, 0xD1342543DE82EF95, np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``raw``; differences of a running sum, so that all words take a few passes."""
    signs = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_WHITE[signs], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_up_to(len(signs) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[: len(signs)])])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        chunk.append((text or "").encode().lower())
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            out += _chunk_sets(chunk)
            chunk, size = [], 0
    return out + (_chunk_sets(chunk) if chunk else [])


def _chunk_sets(chunk: list[bytes]) -> list[np.ndarray]:
    starts, words = _word_hashes(b" ".join(chunk))
    borders = np.cumsum([0, *(len(raw) + 1 for raw in chunk)])
    first = np.searchsorted(starts, borders)
    n = max(0, len(words) - WIDTH + 1)
    rows = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        rows += words[j : j + n] * _PLACES[j]
    rows = mix(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(rows[a : b - WIDTH + 1]))
        elif b > a:
            placed = np.append(words[a:b], np.uint64(b - a)) * np.append(_PLACES[: b - a], _PLACES[WIDTH])
            out.append(mix(placed.sum(keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set, signed; equal sets have equal keys."""
    mixed = mix(shingles + np.uint64(len(shingles)))
    both = mixed.sum(keepdims=True) ^ (np.bitwise_xor.reduce(mixed, keepdims=True) * _BASE)
    return int(mix(both).view(np.int64)[0])


def first_prefix(n: int) -> int:
    """How many shingles, in the order of hashes, stand for a set of ``n``."""
    return n - -(-LIKENESS * n // 100) + max(1, LONGER * n // 100)


def second_prefix(n: Column) -> Column:
    """How many of these, rarest first, suffice: a partner has at least ``need`` shingles, so both share ``t`` of the first prefix."""
    need = F.floor((n * LIKENESS + 99) / 100)
    shared = F.greatest(F.lit(1), F.floor(need * LONGER / 100))
    return n - need + F.greatest(F.lit(1), F.floor(n * LONGER / 100)) - shared + 1


def _batches(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, node, digest``: the size of each document's set, the set's key (null for an empty set) and a digest of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            sets = shingle_sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    batch.column(2),
                ],
                names=["id", "n", "node", "digest"],
            )

    shape = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("digest", T.LongType()),
    ])
    return long_texts(docs).select(id_col, text_col, text_digest(text_col).alias("digest")).mapInArrow(run, shape)


def text_digest(text_col: str | Column) -> Column:
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def prefix_shingles(docs: DataFrame, text_col: str) -> DataFrame:
    """``shingle, node, n``: the first prefix of each set, once per node and task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _batches(batches):
            rows, keys, sizes = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist()):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    rows.append(s[: first_prefix(len(s))])
                    keys.append(key)
                    sizes.append(len(s))
            if rows:
                counts = [len(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.repeat(keys, counts)), pa.array(np.repeat(sizes, counts))],
                    names=["shingle", "node", "n"],
                )
            if len(seen) > REMEMBERED:
                seen.clear()

    return long_texts(docs).select(text_col).mapInArrow(run, "shingle long, node long, n long")


def candidate_edges(prefixes: DataFrame) -> DataFrame:
    """Edges between nodes that share a shingle of their second prefix, each with the one before it only: ``a, b``."""
    by_node = Window.partitionBy("shingle").orderBy("node")
    once = prefixes.withColumn("before", F.lag("node").over(by_node)).filter(F.col("before").isNull() | (F.col("before") != F.col("node")))
    held = once.withColumn("holders", F.count("*").over(Window.partitionBy("shingle"))).filter("holders > 1").select("shingle", "node", "n", "holders")
    held = cut(held, "held")
    n = F.col("n")
    first = n - F.floor((n * LIKENESS + 99) / 100) + F.greatest(F.lit(1), F.floor(n * LONGER / 100))
    ranked = held.withColumns({
        "rank": F.row_number().over(Window.partitionBy("node").orderBy("holders", "shingle")),
        "many": F.count("*").over(Window.partitionBy("node")),
    })
    # shingles held by this node alone come first
    kept = ranked.filter(F.col("rank") + first - F.col("many") <= second_prefix(n)).select("shingle", "node")
    return kept.withColumn("a", F.lag("node").over(by_node)).filter("a is not null").select("a", F.col("node").alias("b")).distinct()


# the signature tree of one group


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Shared shingles that sets of these sizes need to link."""
    return -(-LIKENESS * (a + b) // (100 + LIKENESS))


class SignatureTree:
    """Levels from leaves of ``LEAF`` documents up to one root; each level holds bitmaps, size ranges and hidden tokens of its nodes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        n = len(sizes)
        hidden = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels, width, low = [], LEAF, (sizes, sizes, hidden, bits)
        step = LEAF
        while True:
            at = np.arange(0, len(low[0]), step)
            low = (
                np.minimum.reduceat(low[0], at), np.maximum.reduceat(low[1], at), np.maximum.reduceat(low[2], at), np.bitwise_or.reduceat(low[3], at, axis=0),
            )
            self.levels.append((*low, width))
            if len(at) == 1:
                break
            step, width = FAN, width * FAN
        self.n = n

    def may_link(self, level: int, x: int, y: int) -> bool:
        least, most, hidden, bits, _ = self.levels[level]
        if LIKENESS * max(least[x], least[y]) > 100 * min(most[x], most[y]):
            return False
        common = int(np.bitwise_count(bits[x] & bits[y]).sum()) + min(hidden[x], hidden[y])
        return min(common, most[x], most[y]) >= overlap_needed(int(least[x]), int(least[y]))

    def span(self, level: int, x: int) -> tuple[int, int]:
        width = self.levels[level][4]
        return x * width, min(self.n, (x + 1) * width)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width for all sets: at least two bits for each shingle of the largest set, within bounds."""
    width = 1 << int(np.clip(np.ceil(np.log2(2 * max(map(len, sets)))), 8, 14))
    bits = np.zeros((len(sets), width // 64), np.uint64)
    for row, s in enumerate(sets):
        place = (s >> np.uint64(8)).astype(np.int64) & (width - 1)
        np.bitwise_or.at(bits[row], place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return bits


def links_of_group(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all documents of a group which links connect at all; with ``side`` only between documents of unequal sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    bits = signatures(sets)
    hidden = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
    sides = None if side is None else side[order]
    label = np.arange(len(sets))
    tree, links = SignatureTree(sizes, bits), []

    def compare(x: slice, y: slice) -> None:
        common = np.bitwise_count(bits[x, None, :] & bits[None, y, :]).sum(2, dtype=np.int64)
        most = common + np.minimum(hidden[x, None], hidden[None, y])
        need = overlap_needed(sizes[x, None], sizes[None, y])
        open_pairs = (most >= need) & (np.minimum(sizes[x, None], sizes[None, y]) >= need) & (label[x, None] != label[None, y])
        if sides is not None:
            open_pairs &= sides[x, None] != sides[None, y]
        rows, columns = np.nonzero(open_pairs)
        best = np.argsort(-common[rows, columns], kind="stable")
        for i, j in zip((rows[best] + x.start).tolist(), (columns[best] + y.start).tolist(), strict=True):
            if i != j and label[i] != label[j]:
                shared = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if 100 * shared >= LIKENESS * (len(sets[i]) + len(sets[j]) - shared):
                    links.append((int(order[i]), int(order[j])))
                    label[label == label[j]] = label[i]

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        (a, b), (c, d) = tree.span(level, x), tree.span(level, y)
        if (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
            continue
        if x != y and not tree.may_link(level, x, y):
            continue
        if level == 0:
            compare(slice(a, b), slice(c, d))
            continue
        below = len(tree.levels[level - 1][0])
        left, right = range(x * FAN, min(below, (x + 1) * FAN)), range(y * FAN, min(below, (y + 1) * FAN))
        stack += [(level - 1, i, j) for i in left for j in right if i <= j]
    return links


def links(docs: DataFrame, described: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between nodes, found group by group: ``a, b``. ``groups`` holds ``node, root``."""
    chosen = described.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    wanted = cut(groups.join(sizes, "root").join(chosen, "node").select("id", "node", "root", "blocks"), "wanted")
    ids = small(wanted.select(F.col("id").alias("wanted_id")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), text_col).join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi").select(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"],
            )

    found = texts.mapInArrow(run, "node long, shingles binary")
    held = found.join(small(wanted.select("node", "root", "blocks")), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    paired = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = paired.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "shingles")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        sets = [np.frombuffer(raw, np.uint64) for raw in pdf["shingles"]]
        side = pdf["block"].to_numpy() if pdf["low"].iloc[0] != pdf["high"].iloc[0] else None
        found = links_of_group(sets, side) if len(sets) > 1 else []
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[[i for i, _ in found]], "b": node[[j for _, j in found]]})

    return dealt.groupBy("root", "low", "high").applyInPandas(join, "a long, b long")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, digest, root, component_id``; ``root`` is the class's own key, null for an empty set, which is alone."""
    described = cut(describe(docs, id_col, text_col), "described")
    groups = components(candidate_edges(prefix_shingles(docs, text_col)))
    linked = components(links(docs, described, groups, id_col, text_col))
    rooted = described.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return rooted.join(least, "root", "left").select("id", "n", "digest", "root", F.coalesce("least", "id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``<id column>, n_shingles, component_id``."""
    return _classed(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of smallest id (null last), then of smallest digest of its text; of repeated rows one.

    Classes are told apart by what links them, never by ids, which may be null or shared by unlike texts. Every row of an empty set stays.
    """
    classed = cut(_classed(docs, id_col, text_col).filter("root is not null").select("root", "id", "digest"), "classed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    heads = classed.groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("rows")).filter("rows > 1")
    heads = cut(heads.select("root", F.col("head.id").alias("head_id"), F.col("head.digest").alias("head_digest")), "heads")
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("digest") == F.col("head_digest"))
    judged = classed.join(small(heads), "root").select("id", "digest", is_head.alias("is_head"))
    # a text has one class, so an id with a digest names rows of one class
    pairs = cut(judged.groupBy("id", "digest", "is_head").agg(F.count("*").alias("rows")), "pairs")

    def joined(given: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        found = small(rows.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
        return given.join(found, given[id_col].eqNullSafe(found["__id"]) & (text_digest(given[text_col]) == found["__digest"]), how)

    kept = joined(docs, pairs.filter("not is_head"), "left_anti")
    # only heads that stand in several rows can still be repeated
    repeated = pairs.filter("is_head and rows > 1")
    if not repeated.limit(1).count():
        return kept
    return joined(kept, repeated, "left_anti").unionByName(joined(kept, repeated, "left_semi").dropDuplicates([id_col, text_col]))
