"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

The pre-tokenizer's pattern cuts each text into pieces; the distinct pieces that a task hasn't met before are merged
together in padded numpy matrices, one for each bucket of lengths.  In each round every row merges its leftmost pair of
least rank, found by a hashed lookup; rows without a mergeable pair leave the matrix (compaction).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tessera.llm.arrays import list_array, slices
from tessera.session import spread

#: Public files of tokenizers; a parameter of every function below.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer's pattern of this vocabulary, as published with it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(-1)
#: Pieces longer than this are merged alone, all places of the least pair in a round.
LONG = 256
#: Distinct pieces that a worker remembers, at most; beyond it the memory is started anew.
REMEMBER = 400_000
#: Bytes of a vocabulary's file that are sent to the executors, at most.
MOST_BYTES = 20_000_000


class Bpe:
    """Ranks of a ``.tiktoken`` file's content, with a hashed table from a pair of ids to the id of its merger."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.first = np.full(256, NONE, dtype=np.int32)
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        key = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        to = np.array(to, dtype=np.int32)
        self.bits = np.uint64(64 - max(20, int(len(key) * 6).bit_length()))
        slots = 1 << (64 - int(self.bits))
        self.key, self.to = np.full(slots, ~np.uint64(0)), np.full(slots + 1, NONE, dtype=np.int32)
        slot, todo, self.probes = self._hash(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.key[at] == ~np.uint64(0)
            _, one = np.unique(at, return_index=True)
            take = np.zeros(len(todo), dtype=bool)
            take[one] = True
            take &= free
            self.key[at[take]], self.to[at[take]] = key[todo[take]], to[todo[take]]
            todo = todo[~take]
            slot[todo] = (slot[todo] + 1) & (slots - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merger of each pair, or -1; a padded place (-1) never merges."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._hash(key)
        out = np.full(key.shape, NONE, dtype=np.int32)
        seen = self.key[slot]
        out[hit] = self.to[slot[hit]] if (hit := seen == key).any() else NONE
        todo = np.nonzero(~hit & (seen != ~np.uint64(0)))
        for _ in range(self.probes):
            if not len(todo[0]):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            seen = self.key[slot[todo]]
            hit = seen == key[todo]
            at = tuple(x[hit] for x in todo)
            out[at] = self.to[slot[at]]
            go = ~hit & (seen != ~np.uint64(0))
            todo = tuple(x[go] for x in todo)
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        bucket = np.where(size > LONG, 99, np.ceil(np.log2(np.maximum(size, 2)) * 2).astype(np.int64))
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            if b == 99:
                for r in rows:
                    out[r] = self._long(self.byte[np.frombuffer(pieces[r], dtype=np.uint8)])
                continue
            for at in range(0, len(rows), 4096):
                self._matrix(pieces, rows[at : at + 4096], size, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[np.ndarray]) -> None:
        n, width = size[rows], int(size[rows].max())
        ids = np.full((len(rows), width + 1), NONE, dtype=np.int32)
        ids[np.arange(width + 1) < n[:, None]] = self.byte[np.frombuffer(b"".join(pieces[r] for r in rows), dtype=np.uint8)]
        rank = self._ranks(ids)
        while len(rows):
            col = rank.argmin(axis=1)  # the leftmost of the least
            line = np.arange(len(rows))
            best = rank[line, col]
            done = best == np.iinfo(np.int32).max
            if done.any():
                for r, row, k in zip(rows[done], ids[done], n[done]):
                    out[r] = row[:k].copy()
                go = ~done
                rows, ids, rank, n, col, best = rows[go], ids[go], rank[go], n[go], col[go], best[go]
                if not len(rows):
                    return
                most = int(n.max())
                ids, rank, line = ids[:, : most + 1], rank[:, :most], np.arange(len(rows))
            place = np.arange(ids.shape[1] - 1)
            after = place > col[:, None]
            ids[:, :-1][after] = ids[:, 1:][after]  # close the gap at the right part of the pair
            ids[:, -1] = NONE
            ids[line, col] = best
            n = n - 1
            rank[:, :-1][after[:, :-1]] = rank[:, 1:][after[:, :-1]]
            rank[:, -1] = np.iinfo(np.int32).max
            for c in (col - 1, col):
                ok = c >= 0
                new = self.pair(ids[line[ok], c[ok]], ids[line[ok], c[ok] + 1])
                rank[line[ok], c[ok]] = np.where(new < 0, np.iinfo(np.int32).max, new)

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        new = self.pair(ids[:, :-1], ids[:, 1:])
        return np.where((new < 0) | (ids[:, 1:] < 0), np.iinfo(np.int32).max, new)

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: each round merges every place of the least pair, from left to right without overlap."""
        while len(ids) > 1:
            new = self.pair(ids[:-1], ids[1:])
            able = new >= 0
            if not able.any():
                break
            hit = np.flatnonzero(able & (new == new[able].min()))
            run = np.concatenate(([0], np.cumsum(np.diff(hit) != 1)))  # of places that overlap, each second one
            begin = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
            hit = hit[(np.arange(len(hit)) - begin[run]) % 2 == 0]
            ids = ids.copy()
            ids[hit] = new[hit]
            ids = np.delete(ids, hit + 1)
        return ids


class Encoder:
    """A tokenizer and the pieces that it has met."""

    def __init__(self, content: bytes):
        self.bpe, self.pattern, self.known = Bpe(content), regex.compile(PATTERN), {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        new = list({p for row in pieces for p in row if p not in known})
        if new:
            known.update(zip(new, self.bpe.merge([p.encode("utf-8", "surrogatepass") for p in new])))
        rows = [np.concatenate([known[p] for p in row]) if row else np.empty(0, dtype=np.int32) for row in pieces]
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return (np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)), counts


#: The encoder of a worker, made at its first task; tasks of another vocabulary make their own.
_MADE: dict[str, Encoder] = {}


def _encoder(digest: str, content: Broadcast[bytes]) -> Encoder:
    if digest not in _MADE:
        _MADE.clear()
        _MADE[digest] = Encoder(content.value)
    return _MADE[digest]


def _encode(batches: Iterator[pa.RecordBatch], digest: str, content: Broadcast[bytes]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(digest, content)
    for batch in slices(batches, "text"):
        ids, counts = encoder.encode(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(ids, counts, pa.int32())], names=["doc_id", "ids"])


def encode_corpus(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents(doc_id, text, ...)``, without special tokens.

    Null and empty texts give an empty list, blank texts their ordinary ids; strings of special tokens are ordinary
    text.  Rows that occur twice come out twice, an empty table gives an empty one; further columns are ignored.  The
    vocabulary's file is read here and sent to the executors (an error if it has more than ``MOST_BYTES``).
    """
    content = (Path(tokenizer_dir) / f"{name}.tiktoken").read_bytes()
    if len(content) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(content)
    run = partial(_encode, digest=hashlib.sha256(content).hexdigest(), content=sent)
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")
