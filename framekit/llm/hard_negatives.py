"""Hard negatives by exact integer inner products, multiplied by Strassen's recursion.

Rows are vectors of whole numbers with a label; some of them are anchors. An anchor's positives are the rows of its own label with the
largest inner products; its negatives for one positive are the best rows of other labels whose inner product lies within a window that is
a share of that positive's. Equal products come in ascending id.

Both passes deal their work as cells of at most about ``CELL_ANCHORS`` anchors and ``CELL_ROWS`` candidates. The first brings together
anchors and rows of one bundle of labels, so that only rows that can be positives are multiplied with an anchor; a frequent label is cut into many cells by
the hash of its rows. The second brings the anchors, now with their positives, to all rows. Within a cell, candidates are multiplied
tile by tile, and each anchor keeps a bounded heap (positives) or one per positive (window); heaps of two tiles or of two cells merge by keeping the best
of both. The second pass multiplies what the first did again, since a window is known only when all cells of the first are merged, and keeping products
would take the square of the table.

Tiles are zero-padded to even sizes at each level of the recursion. Sums of int64 wrap around without loss, so a product is exact if it fits
itself.

Which rows take part: those with an id, a label and a vector of only finite numbers. A shorter vector counts as padded with zeros, an empty one has product 0 with all.
Rows whose numbers are so large that a product might pass 2 ** 55 are left out (with 64 components: numbers from about 2.3e7). Equal rows count once; unlike
rows of one id are different rows, and only the row itself is not its own candidate. An anchor without positives, or a window without rows,
gives no rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framekit.llm.common import small
from framekit.session import cut

CELL_ROWS, CELL_ANCHORS = 8_192, 4_096
#: Candidates and anchors of one product. They change speed only.
TILE = 1_024
#: A product with a side of at most this is multiplied directly.
LEAF = 16
#: Stands for "no entry" in a heap; below each product that can occur.
NONE = -(1 << 56)
LARGEST = 1 << 55


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of their zero-padded quarters."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    top, left, right = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:top, :left], a[:top, left:], a[top:, :left], a[top:, left:]
    b11, b12, b21, b22 = b[:left, :right], b[:left, right:], b[left:, :right], b[left:, right:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * top, 2 * right), np.int64)
    out[:top, :right] = p1 + p4 - p5 + p7
    out[:top, right:] = p3 + p5
    out[top:, :right] = p2 + p4
    out[top:, right:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The ``k`` best (score, place) of each of ``m`` owners, best first; places are offered in ascending order, so ties keep the earlier one."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.scores = np.full((m, k), NONE, np.int64)
        self.places = np.zeros((m, k), np.int64)

    def merge(self, scores: np.ndarray, places: np.ndarray) -> None:
        """Keep the best of what is here and what is offered, one row per owner."""
        scores, places = np.hstack([self.scores, scores]), np.hstack([self.places, places])
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores, self.places = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)


def whole_numbers(df: DataFrame, id_col: str, label: Column, vec_col: str, scale: int = 256) -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part; a component ``x`` becomes ``floor(scale * x)``, ``x`` as double."""
    vec = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & label.isNotNull() & vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return df.filter(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x)).alias("vec"),
    )


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of ``width`` int64 numbers, shorter ones padded with zeros."""
    whole = lists.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(whole), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


def _widest(*lists: pa.ChunkedArray) -> int:
    return max(pc.max(pc.list_value_length(column)).as_py() or 0 for column in lists)


class _Cell:
    """The products of the anchors and the rows of one cell, tile by tile."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.anchors = anchors
        width = _widest(anchors["vec"], rows["vec"])
        self.a, self.b = _matrix(anchors["vec"], width), _matrix(self.rows["vec"], width)
        codes = pd.factorize(pd.concat([anchors["label"].to_pandas(), self.rows["label"].to_pandas()], ignore_index=True))[0]
        self.a_label, self.b_label = codes[: len(self.a)], codes[len(self.a) :]
        self.a_key = [anchors[c].to_numpy() for c in ("vec_id", "row")]
        self.b_key = [self.rows[c].to_numpy() for c in ("vec_id", "row")]

    def tiles(self):
        """``first anchor, first row, products, whether the labels are equal, whether both are one row``."""
        for i in range(0, len(self.a), TILE):
            for j in range(0, len(self.b), TILE):
                own, other = slice(i, i + TILE), slice(j, j + TILE)
                products = strassen(self.a[own], np.ascontiguousarray(self.b[other].T))
                same = self.a_label[own, None] == self.b_label[None, other]
                itself = (self.a_key[0][own, None] == self.b_key[0][None, other]) & (self.a_key[1][own, None] == self.b_key[1][None, other])
                yield own, j, products, same, itself


def _positives_in_cell(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        cell = _Cell(anchors, rows)
        heaps: dict[int, Heaps] = {}
        for own, first, products, same, itself in cell.tiles():
            products[~same | itself] = NONE
            order = np.argsort(-products, axis=1, kind="stable")[:, :k]
            heaps.setdefault(own.start, Heaps(len(products), k)).merge(np.take_along_axis(products, order, 1), first + order)
        scores, places = (np.vstack([getattr(h, x) for h in heaps.values()]) for x in ("scores", "places"))
        at, nth = np.nonzero(scores > NONE)
        chosen = places[at, nth]
        columns = [cell.a_key[0][at], cell.a_key[1][at], cell.b_key[0][chosen], cell.b_key[1][chosen], scores[at, nth]]
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))

    return run


def _window_in_cell(k: int, low: int, high: int, base: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_row", "nth", "negative_id", "negative_row", "negative_score"]
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        cell = _Cell(anchors, rows)
        given = anchors["scores"].to_pylist()
        out: list[list[np.ndarray]] = []
        heaps: dict[tuple[int, int], Heaps] = {}
        wanted = max(map(len, given))
        bound = np.full((len(given), wanted), NONE, np.int64)
        for r, scores in enumerate(given):
            bound[r, : len(scores)] = scores
        for own, first, products, same, _ in cell.tiles():
            products[same] = NONE
            order = np.argsort(-products, axis=1, kind="stable")
            ranked = np.take_along_axis(products, order, 1)
            for p in range(wanted):
                positive = bound[own, p, None]
                at = (base * ranked > high * positive).sum(1)[:, None] + np.arange(k)
                inside, at = at < ranked.shape[1], np.minimum(at, ranked.shape[1] - 1)
                scores = np.take_along_axis(ranked, at, 1)
                fits = inside & (positive > NONE) & (scores > NONE) & (low * positive <= base * scores)
                heaps.setdefault((own.start, p), Heaps(len(products), k)).merge(np.where(fits, scores, NONE), first + np.take_along_axis(order, at, 1))
        for (start, p), heap in heaps.items():
            at, nth = np.nonzero(heap.scores > NONE)
            chosen, own = heap.places[at, nth], at + start
            out.append([cell.a_key[0][own], cell.a_key[1][own], np.full(len(at), p), cell.b_key[0][chosen], cell.b_key[1][chosen], heap.scores[at, nth]])
        return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return run


def _spread(n: Column) -> Column:
    """One row for each number below ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _anew(*names: str) -> list[Column]:
    """The same columns under identities of their own, as both sides of a cogroup come from one table."""
    return [F.col(c).alias(c) for c in names]


def _cells(n: str, of: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(n) / of))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, base: int = 100,
    cell_rows: int = CELL_ROWS, cell_anchors: int = CELL_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, vec`` (see ``whole_numbers``); ``is_anchor`` reads these. Of the rows of other labels with
    ``low * positive_score <= base * negative_score <= high * positive_score`` the best ``negatives`` are returned, ranks from 1.
    """
    fits = F.size("vec") * F.pow(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), F.lit(0.0)), 2) < float(LARGEST)
    known = rows.select("vec_id", "label", "vec").filter(fits).distinct().withColumn("row", F.xxhash64("label", "vec"))
    known = cut(known.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    sums = known.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    spread, entry = F.xxhash64("vec_id", "row"), ["vec_id", "row", "label", "vec"]

    # first pass: cells of one bundle of labels
    bundles = max(1, -(-sums["n"] // cell_rows))
    bundled = known.withColumn("bundle", F.pmod(F.xxhash64("label"), F.lit(bundles)))
    sizes = small(bundled.groupBy("bundle").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).filter("a > 0").select(
        "bundle", _cells("n", cell_rows).alias("cells"), _cells("a", cell_anchors).alias("groups"),
    ))
    near = bundled.join(sizes, "bundle")
    left = near.filter("is_anchor").select(
        *_anew("bundle", *entry), F.pmod(spread, "groups").alias("group"), _spread(F.col("cells")).alias("cell"),
    )
    right = near.select(*_anew("bundle", *entry), _spread(F.col("groups")).alias("group"), F.pmod(spread, "cells").alias("cell"))
    keys = ["bundle", "group", "cell"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _positives_in_cell(positives), "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long",
    )
    anchor = ["anchor_id", "anchor_row"]
    best = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    kept = found.withColumn("nth", F.row_number().over(best) - 1).filter(F.col("nth") < positives)
    kept = cut(kept, "positives")

    # second pass: every anchor with its positives meets every row
    per_anchor = kept.groupBy(*anchor).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    groups = max(1, -(-sums["anchors"] // cell_anchors))
    asked = known.filter("is_anchor").join(
        per_anchor.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"), "scores"), ["vec_id", "row"],
    )
    left = asked.select(*_anew(*entry, "scores"), F.pmod(spread, F.lit(groups)).alias("group"), _spread(F.lit(bundles)).alias("cell"))
    right = known.select(*_anew(*entry), _spread(F.lit(groups)).alias("group"), F.pmod(spread, F.lit(bundles)).alias("cell"))
    met = left.groupBy("group", "cell").cogroup(right.groupBy("group", "cell")).applyInArrow(
        _window_in_cell(negatives, low, high, base), "anchor_id long, anchor_row long, nth long, negative_id long, negative_row long, negative_score long",
    )
    best = Window.partitionBy(*anchor, "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.join(kept.withColumn("nth", F.col("nth").cast("long")), [*anchor, "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    )
