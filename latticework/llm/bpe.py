"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by the split pattern; a piece that is a token is that
token, any other is merged pair by pair, lowest rank first and leftmost among
equals. ``merge_piece`` keeps the live pairs of a piece in a segment tree over
byte positions whose nodes hold the leftmost minimum rank: the root names the
next merge, and a merge updates the points of the two live neighbours and of the
position that dies, O(log n) each. A piece of n bytes takes O(n log n), so one
very long piece (a line of a single repeated symbol, say) costs no more per
byte than a short one.

Encoding is a narrow pass: no shuffle, and state per Python worker is the rank
table (read once) and a bounded table of pieces already merged.

Null text counts as empty and gives no ids. Other columns pass through; one
named like the result is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from latticework.llm.batches import map_columns, numbered, small_batches, without_columns
from latticework.llm.memo import Memo

NONE = 1 << 62
#: Fixed value: the split pattern of public byte-level BPE vocabularies.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The same pieces of texts of ASCII and Latin-1 letters, where the standard library's faster engine will do.
_PLAIN_SPLIT = rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
_PLAIN_TEXT = re.compile(rf"[\x00-\x1b\x20-\x7e{_LETTERS[6:]}]*").fullmatch


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load_tokens(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Every single byte must be in ``ranks``."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get, shift = ranks.get, size.bit_length()
    # a leaf is rank << shift | position, so the minimum is the leftmost of the lowest rank
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # end of the live part that begins here
    before = list(range(-1, n - 1))  # begin of the live part to the left

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    mask = (1 << shift) - 1
    while (root := tree[1]) != NONE:
        left = root & mask
        middle = after[left]
        end = after[middle]
        after[left] = end
        if end < n:
            before[end] = left
        if middle < n - 1:
            put(middle, NONE)
        rank = get(piece[left : after[end]]) if end < n else None
        put(left, NONE if rank is None else rank << shift | left)
        if (back := before[left]) >= 0:
            rank = get(piece[back:end])
            put(back, NONE if rank is None else rank << shift | back)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Encoder:
    """Encodes texts with a bounded memo of pieces."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.plain = re.compile(_PLAIN_SPLIT).findall if pattern == _SPLIT else self.find
        self.memo = Memo()

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.memo.old(piece)
        if ids is None:
            ids = tuple(merge_piece(piece.encode(), self.ranks))
        return self.memo.put(piece, ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, extend = self.memo.young.get, ids.extend
        for piece in (self.plain if _PLAIN_TEXT(text) else self.find)(text):
            extend(known(piece) or self._piece(piece))
        return ids


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with ``into`` array<int>: the ids of each whole text."""
    passed = without_columns(docs, [into])
    at, names = passed.columns.index(text_col), [*passed.columns, into]
    kinds = [*[f.dataType for f in passed.schema.fields], T.ArrayType(T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = _encoder(path, pattern).encode
        for batch in small_batches(batches):
            rows = [np.array(encode_text(text.as_py() or ""), np.int32) for text in batch.column(at)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *rows])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=numbered(len(names)))

    return map_columns(passed, run, names, kinds)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with ``into`` binary: the bytes its ids stand for. Unknown ids are an error."""
    passed = without_columns(encoded, [into])
    at, names = passed.columns.index(ids_col), [*passed.columns, into]
    kinds = [*[f.dataType for f in passed.schema.fields], T.BinaryType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load_tokens(path).__getitem__
        for batch in small_batches(batches):
            texts = [b"".join(map(token, row.values.to_numpy(zero_copy_only=False).tolist())) if row.is_valid else b"" for row in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=numbered(len(names)))

    return map_columns(passed, run, names, kinds)
