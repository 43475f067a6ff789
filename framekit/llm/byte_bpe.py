"""Byte-level BPE as a reduction over a tree.

A text is halved until its parts are short; a part is encoded alone, and two neighbours are joined by encoding a window around their seam
again. The window grows until it begins and ends where no token can reach across:

- In the text, between a sign that is no white space and white space. Every match of the split pattern is one run without inner white
  space, with at most one blank before it, or a run of white space, and looks ahead into white space only; so a match ends there, whatever
  stands on the other side, and the matches on either side depend on that side alone.
- Inside one long match, between two tokens whose two texts together encode to just these two tokens. Ids of which all neighbours are
  such pairs are the encoding of their whole text: the first merge across any border would also take place in that pair alone.

Decoding concatenates up the same tree.

A null text is an empty text, its ids an empty list. Rows, and all columns of the input, stay as they are; the new column takes the place
of one of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framekit.llm.common import long_texts, slices

#: Characters of a text, bytes of one match and ids of a list that are handled without halving. They change speed only.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 256, 64, 65536
#: First size of a window around a seam, on each side: characters in a text, tokens in one match.
WINDOW_CHARS, WINDOW_TOKENS = 64, 2
_PER_PROCESS: dict[tuple[str, str], ByteBpe] = {}


def _ends(text: str, at: int) -> bool:
    """Whether a match of the pattern must end at ``at``."""
    return text[at] in " \n\t\r" and not text[at - 1].isspace()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        # the same white space as in the leaf encoder's pattern
        self.ranks, self.pattern = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.fits = lru_cache(1 << 16)(self._fits)

    # one match of the pattern

    def _merged(self, raw: bytes) -> list[int]:
        """Ids of a short run of bytes by merging the neighbours of lowest rank, leftmost first."""
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        return self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _window(self, raw: bytes) -> list[int]:
        return self._merged(raw) if len(raw) <= LEAF_BYTES else self._halved(raw)

    def _halved(self, raw: bytes) -> list[int]:
        middle = len(raw) // 2
        return self.join_in_match(self._window(raw[:middle]), self._window(raw[middle:]))

    def join_in_match(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring parts of one match."""
        take = WINDOW_TOKENS
        while True:
            i, j = max(0, len(left) - take), min(len(right), take)
            raw = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            inner = self._merged(raw)
            if (i == 0 or self.fits(left[i - 1], inner[0])) and (j == len(right) or self.fits(inner[-1], right[j])):
                return left[:i] + inner + right[j:]
            take *= 2

    def encode_match(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is itself a token is that token."""
        rank = self.ranks.get(raw)
        return self._window(raw) if rank is None else [rank]

    # whole texts

    def _leaf(self, text: str) -> np.ndarray:
        if len(text) <= LEAF_CHARS:
            return np.array(self.leaf.encode_ordinary(text), np.int32)
        return np.array([i for m in self.pattern.finditer(text) for i in self.encode_match(m.group().encode())], np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= LEAF_CHARS:
            return self._leaf(text[start:end])
        seam = (start + end) // 2
        return self.join(text, start, seam, end, self._tree(text, start, seam), self._tree(text, seam, end))

    def join(self, text: str, start: int, seam: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``text[start:end]`` from those of its parts before and after ``seam``."""
        width, a, b = WINDOW_CHARS, None, None
        while a is None or b is None:
            low, high = max(start, seam - width), min(end, seam + width)
            if a is None:
                a = next((p for p in range(seam - 1, max(low, start + 1) - 1, -1) if _ends(text, p)), start if low == start else None)
            if b is None:
                b = next((p for p in range(seam + 1, high) if _ends(text, p)), end if high == end else None)
            width *= 2
        return np.concatenate([self._before(left, len(text[a:seam].encode())), self._leaf(text[a:b]), self._after(right, len(text[seam:b].encode()))])

    def _before(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        """Without the last tokens, which hold ``n_bytes`` together."""
        sizes = np.cumsum(self.size_of[ids[::-1]])
        return ids[: len(ids) - int(np.searchsorted(sizes, n_bytes, "left")) - 1] if n_bytes else ids

    def _after(self, ids: np.ndarray, n_bytes: int) -> np.ndarray:
        return ids[int(np.searchsorted(np.cumsum(self.size_of[ids]), n_bytes, "left")) + 1 :] if n_bytes else ids

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of this Python process."""
    if (path, pattern) not in _PER_PROCESS:
        _PER_PROCESS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _PER_PROCESS[path, pattern]


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, convert) -> DataFrame:
    """``df`` with a column ``name`` that ``convert`` makes from the values of ``source``."""
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    at = [f.name for f in df.schema.fields].index(source)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            others = [batch.column(i) for i, f in enumerate(batch.schema) if f.name.lower() != name.lower()]
            yield pa.RecordBatch.from_arrays([*others, convert(batch.column(at))], names=[*(f.name for f in kept), name])

    return long_texts(df).mapInArrow(run, T.StructType([*kept, T.StructField(name, kind)]))


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text."""

    def convert(texts: pa.Array) -> pa.Array:
        bpe = codec(ranks, pattern)
        ids = [bpe.encode(text or "") for text in texts.to_pylist()]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return _with_column(docs, text_col, ids_col, T.ArrayType(T.IntegerType(), False), convert)


def decode(df: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids are an empty list."""

    def convert(lists: pa.Array) -> pa.Array:
        bpe = codec(ranks, pattern)
        flat, edges, there = lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
        return pa.array([bpe.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(edges[:-1], edges[1:], there, strict=True)], pa.binary())

    return _with_column(df, ids_col, bytes_col, T.BinaryType(), convert)
