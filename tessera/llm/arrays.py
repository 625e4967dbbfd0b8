"""Words of a batch of texts as numpy columns, and helpers for Arrow batches.

A word is a maximal run of Unicode letters or digits of the lower-cased text (``str.isalnum`` is true exactly for the
categories L* and N*).  Words are represented by 64-bit hashes, so a batch of texts needs no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_UNBASE = U(pow(int(_BASE), -1, 1 << 64))


@cache
def letter_table() -> np.ndarray:
    """True for each code point that belongs to a word."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _code_hash() -> np.ndarray:
    return np.where(letter_table(), mix(np.arange(1, 0x110001, dtype=U)), U(0))


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n + 1).bit_length()))


class Words:
    """Columns ``doc`` (index of the text), ``hash``, ``start`` and ``end`` (code points in the joined text) of all words."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        self.size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        self.offset = np.concatenate(([0], np.cumsum(self.size + 1)))[: len(low)]
        self.codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.concatenate(([False], letter_table()[self.codes], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        n = len(self.codes)
        total = np.concatenate(([U(0)], np.cumsum(_code_hash()[self.codes] * _power(int(_BASE), n)[:n], dtype=U)))
        self.hash = mix((total[self.end] - total[self.start]) * _power(int(_UNBASE), n)[self.start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``n`` successive words of one text, and the index of its first word."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        total = np.zeros(count, dtype=U)
        for k in range(n):
            total = total * U(0xD6E8FEB86659FD93) + self.hash[k : k + count]
        first = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return mix(total[first]), first


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, so that memory doesn't follow the length of texts."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size + 64) // most
        edge = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
