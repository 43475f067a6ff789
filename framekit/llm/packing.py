"""Packing by concatenating and cutting.

All documents, each followed by an end id, form one long run of ids that is cut into windows of ``capacity``. The place of a document in
that run takes two passes over partition totals: the first pass encodes the texts, counts ids inside each task and writes them to the
shared folder; then one row per task is summed in task order, and the second pass adds the offset of its task to each document and cuts it
where a window ends. No document moves between tasks.

Rows: one per piece, ``<id column>, start, length, doc_tokens, sequence_id, offset, piece``. ``piece`` holds the ids as little-endian
unsigned 32-bit numbers. A piece never crosses a window and every id lies in exactly one piece. Only the last window can be short.

Null texts are empty texts; an empty text is its end id alone. Null and repeated ids stay, one document per row. An empty table gives no
rows. Other columns of the input are not read, so that their names don't matter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import long_texts, slices, small
from framekit.session import cut

CAPACITY = 2048
END_ID = 1
#: Words that a Python worker remembers; beyond it the memory starts anew. It changes speed only.
REMEMBERED = 600_000
_PER_PROCESS: dict[str, WordEncoder] = {}


def _byte_signs() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in signs:
            signs[b], extra = chr(extra), extra + 1
    return [signs[b] for b in range(256)]


#: What the tokenizer's pattern finds in a word without apostrophes: letters, one digit, or a run of other signs.
PIECES = re.compile(r"[^\W\d_]+|\d|[\W_]+")


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers, which are joined faster than lists."""
    found = array("i", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordEncoder:
    """Ids (see ``as_bytes``) of whole texts by a tokenizer that drops white space, hence word by word.

    Text between ASCII white space is encoded once and remembered, and so are its runs of letters, which go straight to the model. Words with
    apostrophes, uncomposed letters, control strings or a lower case that depends on the context take the tokenizer's whole path.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.signs = _byte_signs()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """Ids of a run of letters in composed form."""
        found = self.pieces.get(word)
        if found is None:
            lower = word.lower()
            if lower.isascii():
                found = as_bytes([t.id for t in self.tokenizer.model.tokenize(lower)])
            elif "Σ" in word or not lower.isalpha():
                found = self._whole(word)
            else:
                found = as_bytes([t.id for t in self.tokenizer.model.tokenize("".join(map(self.signs.__getitem__, lower.encode())))])
            self.pieces[word] = found
        return found

    def _signs(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self._whole(piece)
        return found

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if not word.isascii() and ("İ" in word or not unicodedata.is_normalized("NFC", word)):
            return self._whole(word)  # that letter's lower case holds a sign that is no letter
        if word.isalpha():
            return self._letters(word)
        if "'" in word or "<|" in word:
            return self._whole(word)
        return b"".join(self._letters(p) if p.isalpha() else self._signs(p) for p in PIECES.findall(word))

    def __call__(self, text: str) -> bytes:
        words, known = text.encode().split(), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
        ids = b"".join(map(known.__getitem__, words))
        if len(known) + len(self.pieces) > REMEMBERED:
            known.clear()
            self.pieces.clear()
        return ids


def word_encoder(path: str) -> Callable[[str], bytes]:
    """The encoder of this Python process."""
    if path not in _PER_PROCESS:
        _PER_PROCESS[path] = WordEncoder(path)
    return _PER_PROCESS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """First pass: ``part, <id column>, before, ids``, where ``before`` counts the ids that the same task has made earlier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, to_ids, end = TaskContext.get().partitionId(), 0, word_encoder(tokenizer), as_bytes([end_id])
        for batch in slices(batches):
            ids = [to_ids(text or "") + end for text in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4").astype(np.int32, copy=False))
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(edges, flat)],
                names=["part", id_col, "before", "doc_tokens", "ids"],
            )

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("before", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])
    return long_texts(docs).select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in windows of ``capacity`` ids; see the module's text."""
    encoded = cut(encode(docs, tokenizer, id_col, text_col, end_id), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    parts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = encoded.join(small(parts), "part").select(id_col, (F.col("base") + F.col("before")).alias("at"), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(2)
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "doc_tokens", "sequence_id", "offset", "piece")}
            for row, at in enumerate(batch.column(1).to_pylist()):
                first, n = int(edges[row]), int(edges[row + 1] - edges[row])
                start = 0
                while start < n:
                    offset = (at + start) % capacity
                    length = min(n - start, capacity - offset)
                    piece = flat[first + start : first + start + length].astype("<u4").tobytes()
                    for name, value in zip(rows, (row, start, length, n, (at + start) // capacity, offset, piece), strict=True):
                        rows[name].append(value)
                    start += length
            owner = batch.column(0).take(pa.array(rows.pop("row"), pa.int64()))
            pieces = pa.array(rows.pop("piece"), pa.binary())
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(v, pa.int64()) for v in rows.values()), pieces], names=[id_col, *rows, "piece"])

    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, T.LongType()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")),
        T.StructField("piece", T.BinaryType()),
    ])
    return placed.mapInArrow(run, schema)
