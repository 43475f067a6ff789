"""Nearest neighbours by inner product with an inverted multi-index.

Each vector is cut into two halves, and each half is quantised by its own codebook (k-means over a bounded sample). A vector is filed in the
cell of its two centroids. A query walks the pairs of centroids in descending order of the sum of its two inner products with them, by a
heap, until the cells that it has met hold a given share of all vectors; these entries are reranked by their inner products.

Work is dealt as (block of entries, block of queries): a block of entries holds at most about ``BLOCK_ENTRIES`` of one or more cells, and a
larger cell is cut into several blocks, so that no task holds a whole hot cell. A query goes only to the blocks of its cells.

Equal vectors are one entry with their smallest ``k + 1`` ids, since only those can be among ``k`` nearest (ties go to the smaller id, and
a query leaves out its own id). Scores are inner products of the original vectors, summed with extended precision.

Vectors that are null, of zero length, or hold null or non-finite components take no part; nor do null ids and vectors whose number of
components is not the table's most frequent one. Repeated rows count once. A query with fewer candidates than ``k`` gets all of those that
it has met; a table of at most ``LEAST_ENTRIES`` entries is searched whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from math import sumprod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framekit.session import cut

#: Vectors from which the codebooks are fitted: those with the smallest hashes.
SAMPLE = 16_384
#: Centroids of each half.
CENTROIDS = 64
#: Share of all entries that the cells of a query must hold, and the number below which all cells are visited.
SHARE, LEAST_ENTRIES = 0.5, 2_000
BLOCK_ENTRIES, BLOCK_QUERIES = 4_096, 1_024
ROUNDS = 10


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec`` of the rows that take part, vectors in double precision."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0),
    )
    widths = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.filter(F.size("vec") == (widths[0]["width"] if widths else 0))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their ``k + 1`` smallest ids: ``hash, vec, ids``."""
    keyed = vectors.withColumn("hash", F.xxhash64("vec")).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    first = F.dense_rank().over(Window.partitionBy("hash", "vec").orderBy("vec_id"))
    return keyed.withColumn("nth", first).filter(F.col("nth") <= k + 1).groupBy("hash", "vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (2 * points @ centroids.T - (centroids * centroids).sum(1)).argmax(1)


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids; the first are points spread evenly over the given order."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(points, centroids)
        for j in range(k):
            own = points[owner == j]
            if len(own):
                centroids[j] = own.mean(0)
    return centroids


def fit(found: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray] | None:
    """The two codebooks, or None for an empty table; each is fitted in a task of its own from the same bounded sample."""
    chosen = found.select("hash", "vec").orderBy("hash", "vec").limit(sample)
    halves = chosen.select("vec", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        points, half = np.array(pdf["vec"].tolist(), float), int(pdf["half"].iloc[0])
        middle = points.shape[1] // 2
        part = points[:, :middle] if half == 0 else points[:, middle:]
        book = k_means(part, max(1, min(centroids, len(part) // 8)))
        return pd.DataFrame({"half": half, "centroid": list(book)})

    rows = halves.groupBy("half").applyInPandas(one, "half int, centroid array<double>").collect()  # at most two codebooks
    if not rows:
        return None
    return tuple(np.array([r.centroid for r in rows if r.half == half], float) for half in (0, 1))


def _cells(vecs: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    middle = vecs.shape[1] // 2
    return _nearest(vecs[:, :middle], books[0]) * len(books[1]) + _nearest(vecs[:, middle:], books[1])


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def file_entries(found: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``found`` with its cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _cells(_vectors(batch.column(1)), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=["hash", "vec", "ids", "cell"])

    return found.select("hash", "vec", "ids").mapInArrow(run, "hash long, vec array<double>, ids array<bigint>, cell int")


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in descending order of ``first[i] + second[j]`` until they hold ``wanted`` entries; only cells with entries are given."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b, width = first[rows].tolist(), second[columns].tolist(), len(second)
    rows, columns = rows.tolist(), columns.tolist()
    heap, met, held = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * width + columns[j]
        if counts[cell]:
            met.append(cell)
            held += counts[cell]
        if j + 1 < width:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return met


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``."""
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    vectors = usable(df, id_col, vec_col)
    found = cut(entries(vectors, k), "entries")
    books = fit(found)
    if books is None:
        return spark.createDataFrame([], out)
    filed = cut(file_entries(found, books), "filed")
    n_cells = len(books[0]) * len(books[1])
    counts = np.zeros(n_cells, np.int64)
    for r in filed.groupBy("cell").count().collect():  # at most CENTROIDS ** 2 rows
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    wanted = total if total <= LEAST_ENTRIES else max(LEAST_ENTRIES, int(np.ceil(share * total)))
    chunks = np.maximum(1, -(-counts // BLOCK_ENTRIES))
    # neighbouring small cells share a block; a large cell has blocks of its own
    start, block, held = np.zeros(n_cells, np.int64), 0, 0
    for cell in range(n_cells):
        if held and held + counts[cell] > BLOCK_ENTRIES:
            block, held = block + 1, 0
        start[cell] = block
        held += counts[cell]
        if chunks[cell] > 1:
            block, held = block + int(chunks[cell]), 0
    asked = vectors.filter(is_query).distinct()
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    small_counts, starts, cuts = counts.tolist(), start.tolist(), chunks.tolist()

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), _vectors(batch.column(1))
            middle = vecs.shape[1] // 2
            rows: list[int] = []
            blocks: list[int] = []
            cells: list[list[int]] = []
            for row in range(len(ids)):
                of_block: dict[int, list[int]] = {}
                for cell in walk(books[0] @ vecs[row, :middle], books[1] @ vecs[row, middle:], small_counts, wanted):
                    for b in range(starts[cell], starts[cell] + cuts[cell]):
                        of_block.setdefault(b, []).append(cell)
                rows += [row] * len(of_block)
                blocks += of_block
                cells += of_block.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                names=["query_id", "query", "block", "cells"],
            )

    probes = asked.select(F.col("vec_id").cast("long"), "vec").mapInArrow(probe, "query_id long, query array<double>, block long, cells array<int>")
    probes = probes.withColumn("part", F.pmod(F.xxhash64("query_id", "query"), F.lit(query_blocks)))
    lookup = spark.createDataFrame([(c, starts[c], cuts[c]) for c in range(n_cells) if counts[c]], "cell int, start long, chunks long")
    placed = filed.join(F.broadcast(lookup), "cell").select(  # at most CENTROIDS ** 2 rows are broadcast
        (F.col("start") + F.pmod(F.xxhash64("hash"), F.col("chunks"))).alias("block"), "cell", "vec", "ids",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("part"),
    )

    def rerank(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {"query_id": [], "ids": [], "score": []}
        if len(queries) and len(stored):
            q, x, cell = np.array(queries["query"].tolist()), np.array(stored["vec"].tolist()), stored["cell"].to_numpy()
            scores = q @ x.T
            for row, (query_id, cells) in enumerate(zip(queries["query_id"], queries["cells"], strict=True)):
                own = np.flatnonzero(np.isin(cell, np.asarray(cells)))
                s = scores[row, own]
                if len(own) > k + 1:
                    # rounding differs between ways to sum, so that all near the last place are kept
                    least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    own = own[s >= least - 1e-9 * max(1.0, abs(least), float(np.abs(s).max()))]
                exact = q[row].tolist()
                rows["query_id"] += [query_id] * len(own)
                rows["ids"] += [stored["ids"].iat[i] for i in own]
                rows["score"] += [sumprod(exact, x[i].tolist()) for i in own]
        return pd.DataFrame(rows)

    near = probes.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInPandas(rerank, "query_id long, ids array<bigint>, score double")
    single = near.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
