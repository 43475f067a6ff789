"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order, and the probabilities of the earlier ones are features of the later ones. For training, these
probabilities are out-of-fold: each labelled row's comes from models that have not seen its fold, so that a later model learns from errors
like those it will meet. At prediction they come from models fitted on all folds.

Features are the words of a text and their beginnings of four to seven letters, so that inflected and compound forms of one stem count
together, each as present at least once, twice and four times. For each category the ``FEATURES`` ones most unevenly spread between its two classes are kept, by the z score of the
difference of their shares, of those that occur in at least ``LEAST_DOCS`` labelled texts. Models are logistic regressions.

Only the fit is bounded: it uses at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids. Counting features and
predicting run over whole texts in Spark; the driver holds features and weights, at most ``FEATURES`` per category.

A null text is empty; an empty one gets the probabilities of the intercepts. Labels that are null are left out of the sample. A category
without labelled rows, or with one class only, has that class's share as its probability (0 without rows). Rows and other columns of the
input stay; columns of the same names as the new ones are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import long_texts, slices
from framekit.llm.shingle_join import LIKENESS, shingle_sets
from framekit.session import cut

SAMPLE = 16_384
FEATURES = 2_048
#: Least number of labelled texts with a feature: a tenth of the positive ones, within these bounds.
LEAST_DOCS, LEAST_Z = (5, 8), 4.0
#: Hashes in the signature of a labelled text, how many of its first ones bring texts together, and how many of these near copies share.
SIGNATURE, FIRST, SHARED = 256, 16, 4
FOLDS = 5
PENALTY = 1e-3
STEPS = 300
STEMS = (4, 5, 6, 7)
#: A feature is present when its word or stem occurs so many times.
TIMES = (1, 2, 4)
#: Words whose features a Python worker remembers, and counts that a task holds before it hands them on. They change speed only.
REMEMBERED, HELD = 250_000, 200_000
_SEPARATORS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def words(text: str) -> Counter[bytes]:
    """Words in lower case, cut at all ASCII signs but letters and digits, with their counts."""
    return Counter(text.lower().encode().translate(_SEPARATORS).split())


def word_features(word: bytes) -> list[str]:
    plain = word.decode()
    return [plain, *(f"{plain[:n]}~" for n in STEMS if len(plain) > n)]


def text_features(found: Counter[bytes]) -> list[tuple[str, int]]:
    """The features present in a text, as (word or stem, least count)."""
    counts: Counter[str] = Counter()
    for word, n in found.items():
        for name in word_features(word):
            counts[name] += n
    return [(name, least) for name, n in counts.items() for least in TIMES if n >= least]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``SIGNATURE`` smallest hashes of a text's shingles, in order; all of a set that has no more."""
    return shingles[:SIGNATURE]


def without_copies(digests: Sequence[int], signatures: Sequence[np.ndarray], classes: Sequence[tuple]) -> list[int]:
    """Places of the rows that stay, in order: a row goes if an earlier one that stays, of the same class, is its copy or near copy.

    Likeness is that of the hashes up to the smaller end of two signatures, so it is exact for sets that fit into theirs. Only rows are compared
    that share up to ``SHARED`` of their first ``FIRST`` hashes, as near copies do.
    """
    kept: list[int] = []
    same: set[tuple] = set()
    holders: dict[tuple, list[int]] = {}
    table = np.full((len(signatures), SIGNATURE), np.iinfo(np.uint64).max)
    ends = np.full(len(signatures), np.iinfo(np.uint64).max)
    for row, (digest, own, of) in enumerate(zip(digests, signatures, classes, strict=True)):
        if (digest, of) in same:
            continue
        n = len(own)
        if n:
            first = own[:FIRST].tolist()
            found, shared = np.unique([r for h in first for r in holders.get((h, of), ())], return_counts=True)
            others = found[shared >= min(SHARED, -(-LIKENESS * n // 100))].astype(np.int64)
            table[row, :n] = own
            if n == SIGNATURE:
                ends[row] = own[-1]
            if len(others):
                end = np.minimum(ends[others], ends[row])
                theirs = table[others]
                within = theirs <= end[:, None]
                within &= theirs != np.iinfo(np.uint64).max
                common = (np.isin(theirs, own) & within).sum(1)
                union = within.sum(1) + np.searchsorted(own, end, "right") - common
                if (100 * common >= LIKENESS * union).any():
                    continue
            for h in first:
                holders.setdefault((h, of), []).append(row)
        same.add((digest, of))
        kept.append(row)
    return kept


@dataclass
class Chain:
    """``features[c]`` maps a feature to its place among the weights of category ``c``; the last weights are those of earlier categories and 1."""

    categories: Sequence[str]
    features: list[dict[tuple[str, int], int]]
    weights: list[np.ndarray]
    known: dict[bytes, tuple[str, ...]] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)

    def places(self, found: Counter[bytes]) -> list[list[int]]:
        """Places of the features present in a text, for each category."""
        if not self.names:
            self.names = {name for of in self.features for name, _ in of} | {""}
        known, counts = self.known, Counter()
        for word, n in found.items():
            hits = known.get(word)
            if hits is None:
                hits = known[word] = tuple(name for name in word_features(word) if name in self.names)
            for name in hits:
                counts[name] += n
        if len(known) > REMEMBERED:
            known.clear()
        present = [(name, least) for name, n in counts.items() for least in TIMES if n >= least]
        return [sorted(of[f] for f in present if f in of) for of in self.features]

    def probabilities(self, text: str) -> list[float]:
        earlier: list[float] = []
        for place, weight in zip(self.places(words(text)), self.weights, strict=True):
            x = float(weight[place].sum()) if place else 0.0
            n = len(earlier)
            x += sum(p * w for p, w in zip(earlier, weight[len(weight) - 1 - n : -1], strict=True)) + float(weight[-1])
            earlier.append(float(1 / (1 + np.exp(-np.clip(x, -40, 40)))))
        return earlier


def fit_linear(rows: list[np.ndarray], n_features: int, extra: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the present features, of the columns of ``extra`` and the intercept, by accelerated gradient steps."""
    n, n_extra = len(y), extra.shape[1]
    weight = np.zeros(n_features + n_extra + 1)
    share = y.mean() if n else 0.0
    if not 0 < share < 1:
        weight[-1] = 40 * (2 * share - 1)
        return weight
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate([np.empty(0, np.int64), *rows]), np.repeat(np.arange(n), sizes)
    # a diagonal scale lets rare, telling features move as far as frequent ones
    count = np.bincount(flat, minlength=n_features)[:n_features]
    scale = 1 / np.sqrt(np.concatenate([np.maximum(count, 1) / n, np.maximum((extra**2).mean(0), 1e-3), [1.0]]))
    reach = np.zeros(n)
    np.add.at(reach, owner, scale[flat] ** 2)
    step = 4 / (reach.mean() + n_extra + 1 + 4 * PENALTY)
    at, before, momentum = weight.copy(), weight.copy(), 1.0
    for _ in range(STEPS):
        w = at * scale
        x = np.bincount(owner, w[flat], minlength=n) + extra @ w[n_features:-1] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(x, -40, 40))) - y
        grad = np.concatenate([np.bincount(flat, r[owner], minlength=n_features)[:n_features], extra.T @ r, [r.sum()]]) / n
        grad = grad * scale + PENALTY * at * np.append(np.ones(len(at) - 1), 0)
        new = at - step * grad
        if (grad * (new - before)).sum() > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        at, before, momentum = new + (momentum - 1) / following * (new - before), new, following
    return before * scale


def _predict(rows: list[np.ndarray], n_features: int, extra: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.array([weight[r].sum() for r in rows]) + extra @ weight[n_features:-1] + weight[-1]
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_chain(places: list[list[np.ndarray]], n_features: list[int], labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Weights of each category. ``labels`` may hold NaN; such rows train no model of that category but keep their place in the chain."""
    n, weights = len(fold), []
    earlier = np.empty((n, 0))
    for c, rows in enumerate(places):
        y = labels[:, c]
        there = ~np.isnan(y)

        def fitted(mask: np.ndarray, rows=rows, y=y, c=c, earlier=earlier) -> np.ndarray:
            own = np.flatnonzero(mask)
            return fit_linear([rows[i] for i in own], n_features[c], earlier[own], y[own])

        weights.append(fitted(there))
        out = np.zeros(n)
        for f in range(FOLDS):
            held = np.flatnonzero(fold == f)
            if len(held):
                out[held] = _predict([rows[i] for i in held], n_features[c], earlier[held], fitted(there & (fold != f)))
        earlier = np.column_stack([earlier, out])
    return weights


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, sample: int) -> DataFrame:
    """``id, text`` and the category columns of the labelled documents with the smallest hashes.

    Of copies and near copies with the same labels the one of smallest id is kept, lest a much copied text makes its rare words look telling.
    """
    ids = labels.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(c) for c in categories)).filter(
        F.col("id").isNotNull() & F.coalesce(*categories).isNotNull(),
    )
    chosen = ids.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id", *categories).limit(sample).drop("hash")
    rows = long_texts(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [signature(s).tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "signature"])

    signed = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("signature", T.BinaryType())]))
    keyed = cut(signed.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()}), "labelled")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "digest"], kind="stable")
        classes = [tuple(None if pd.isna(x) else float(x) for x in of) for of in pdf[list(categories)].itertuples(index=False)]
        stay = without_copies(pdf["digest"].tolist(), [np.frombuffer(x, np.uint64) for x in pdf["signature"]], classes)
        return pd.DataFrame({"row": pdf["row"].to_numpy()[stay]})

    # the sample is bounded and its signatures are short, so one task may hold them
    one = keyed.select("id", "digest", "row", "signature", *categories).withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(thin, "row long")
    return keyed.join(one, "row", "left_semi").select("id", "text", *categories)


def count_features(sample: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``category, feature, least, pos, neg``: labelled texts with the feature in each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def given() -> pa.RecordBatch:
            counts = np.array(list(held.values()), np.int64).reshape(len(held), 2 * len(categories))
            names, least = [f[0] for f in held], [f[1] for f in held]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(least, pa.int32()), pa.array(list(counts), pa.list_(pa.int64()))], names=["feature", "least", "n"])

        for batch in slices(batches):
            texts, classes = batch.column(0).to_pylist(), list(zip(*(batch.column(1 + i).to_pylist() for i in range(len(categories))), strict=True))
            for text, labels in zip(texts, classes, strict=True):
                own = np.array([v for y in labels for v in ((y == 1, y == 0) if y is not None else (0, 0))], np.int64)
                for name in text_features(words(text)):
                    if name in held:
                        held[name] += own
                    else:
                        held[name] = own.copy()
            if len(held) > HELD:
                yield given()
                held.clear()
        yield given()

    counted = sample.select("text", *categories).mapInArrow(run, "feature string, least int, n array<bigint>")
    summed = counted.groupBy("feature", "least").agg(*(F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * len(categories))))
    one = F.array(*(F.struct(F.lit(i).alias("category"), F.col(f"n{2 * i}").alias("pos"), F.col(f"n{2 * i + 1}").alias("neg")) for i in range(len(categories))))
    return summed.select("feature", "least", F.explode(one).alias("x")).select("x.category", "feature", "least", "x.pos", "x.neg")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    rows = cut(labelled_sample(docs, labels, categories, id_col, text_col, sample), "labelled")
    sizes = rows.agg(*(F.coalesce(F.sum(F.when(F.col(c) == v, 1)), F.lit(0)).alias(f"{c}_{v}") for c in categories for v in (1, 0))).first()
    counts = cut(count_features(rows, categories), "features")
    features: list[dict[tuple[str, int], int]] = []
    for i, c in enumerate(categories):
        n_pos, n_neg = sizes[f"{c}_1"], sizes[f"{c}_0"]
        least_docs = min(max(n_pos // 10, LEAST_DOCS[0]), LEAST_DOCS[1])
        share = (F.col("pos") + F.col("neg")) / (n_pos + n_neg or 1)
        spread = F.sqrt(share * (1 - share) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)) + 1e-12)
        z = F.abs(F.col("pos") / max(n_pos, 1) - F.col("neg") / max(n_neg, 1)) / spread
        best = counts.filter((F.col("category") == i) & (F.col("pos") + F.col("neg") >= least_docs)).withColumn("z", z)
        kept = best.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature", "least").limit(FEATURES).select("feature", "least").collect()
        features.append({(r.feature, r.least): at for at, r in enumerate(kept)})
    blank = Chain(categories, features, [])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places = [blank.places(words(text)) for text in batch.column(0).to_pylist()]
            lists = [pa.array([p[c] for p in places], pa.list_(pa.int64())) for c in range(len(categories))]
            yield pa.RecordBatch.from_arrays([*lists, *batch.columns[1:]], names=[*(f"x{c}" for c in range(len(categories))), *categories, "fold"])

    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    shape = ", ".join([*(f"x{c} array<bigint>" for c in range(len(categories))), *(f"`{c}` double" for c in categories), "fold int"])
    encoded = rows.select("text", *categories, fold).mapInArrow(encode, shape)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        places = [[np.asarray(x, np.int64) for x in pdf[f"x{c}"]] for c in range(len(categories))]
        weights = fit_chain(places, [len(f) for f in features], pdf[list(categories)].to_numpy(float), pdf["fold"].to_numpy())
        return pd.DataFrame({"category": range(len(weights)), "weights": weights})

    # the sample is bounded, so one task may hold it
    fitted = {r.category: np.array(r.weights) for r in encoded.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(train, "category int, weights array<double>").collect()}
    none = [np.append(np.zeros(len(f) + c), -40.0) for c, f in enumerate(features)]
    return Chain(categories, features, [fitted.get(c, none[c]) for c in range(len(categories))])


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` for each category."""
    names = [prefix + c for c in chain.categories]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    at = [f.name for f in docs.schema.fields].index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([chain.probabilities(text or "") for text in batch.column(at).to_pylist()]).reshape(batch.num_rows, len(names))
            others = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(found[:, c]) for c in range(len(names)))], names=[*(f.name for f in kept), *names])

    return long_texts(docs).mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``p_junk``, ``p_toxic`` and the decision ``is_toxic``, fitted on ``labels`` (doc_id, quality, toxic)."""
    chained = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").alias("toxic"))
    chain = fit(docs, chained, ("junk", "toxic"), sample=sample)
    return predict(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= threshold)
