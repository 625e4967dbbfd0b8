"""Problem 5: splitting oversized texts at natural boundaries, by agglomerative merging of atomic segments.

Atomic segments are the pieces between the places of the strongest kind of boundary that leaves none over the limit.
Adjacent pairs wait in a heap, the weakest boundary between them first, and are merged while the merged piece with its
overlap fits.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import slices

#: Tokens of a piece at most, and of the part that repeats the end of the piece before; a token is four characters.
LIMIT, OVERLAP, CHARS = 512, 50, 4
#: Kinds of boundary, strongest first; each pattern matches what stands between two pieces.
BOUNDARIES = {
    "paragraph": re.compile(r"[ \t\r]*\n(?:[ \t\r]*\n)+"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"(?<=[.!?])[ \t\r\n]+"),
    "word": re.compile(r"[ \t\r\n]+"),
}


def tokens(size: int) -> int:
    return size // CHARS


def atoms(text: str, most: int) -> tuple[str, list[tuple[int, int]]]:
    """The first boundary whose pieces all have ``most`` tokens or less, and the pieces' places; else ``none`` and cuts
    at words where they are near enough, at characters elsewhere."""
    for name, pattern in BOUNDARIES.items():
        edge = [0, *(x for m in pattern.finditer(text) for x in m.span()), len(text)]
        spans = [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b > a]
        if all(tokens(b - a) <= most for a, b in spans):
            return name, spans
    step = (most // 2) * CHARS
    return "none", [(k, min(k + step, b)) for a, b in spans for k in range(a, b, step)]


def _strength(text: str, a: int, b: int) -> int:
    """How strong the boundary is between a piece that ends at ``a`` and the next, which begins at ``b``."""
    gap = text[a:b]
    if gap.count("\n") > 1 and BOUNDARIES["paragraph"].search(gap):
        return 4
    sentence = text[a - 1 : a] in (".", "!", "?")
    return 3 if "\n" in gap and sentence else 2 if sentence else 1 if gap else 0


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The kind of boundary used, and each piece as (begin of its overlap, begin, end)."""
    kind, spans = atoms(text, limit)
    room = (limit - overlap) * CHARS
    # atoms that fit alone but not with an overlap stay alone; their overlap shrinks to what fits
    left, right = list(range(-1, len(spans) - 1)), list(range(1, len(spans) + 1))
    begin, end, alive = [a for a, _ in spans], [b for _, b in spans], [True] * len(spans)
    heap = [(_strength(text, end[k], begin[k + 1]), end[k + 1] - begin[k], k, k + 1) for k in range(len(spans) - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or end[b] - begin[a] != size or size > room:
            continue
        end[a], alive[b], right[a] = end[b], False, right[b]
        if right[a] < len(spans):
            left[right[a]] = a
            heapq.heappush(heap, (_strength(text, end[a], begin[right[a]]), end[right[a]] - begin[a], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (_strength(text, end[left[a]], begin[a]), end[a] - begin[left[a]], left[a], a))
    out: list[tuple[int, int, int]] = []
    for k in (k for k in range(len(spans)) if alive[k]):
        at = begin[k]
        if out:
            at = max(out[-1][1], begin[k] - overlap * CHARS, end[k] - limit * CHARS - (CHARS - 1))
            if at < begin[k] and not text[at - 1].isspace():  # the overlap begins at a word, if there is one
                space = re.compile(r"\s").search(text, at, begin[k])
                at = space.end() if space else at if kind == "none" else begin[k]
        out.append((min(at, begin[k]), begin[k], end[k]))
    return kind, out


SCHEMA = "chunk_id string, boundary string, pieces array<struct<split_sequence:string,content:string,overlap:int,token_count:int>>"


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("split_sequence", pa.string()), ("content", pa.string()), ("overlap", pa.int32()), ("token_count", pa.int32())]))
    for batch in slices(batches, "content"):
        names, rows = [], []
        for text in batch.column("content").to_pylist():
            name, cut = pieces(text, limit, overlap)
            names.append(name)
            rows.append([(f"{k}/{len(cut)}", text[o:b], a - o, tokens(b - o)) for k, (o, a, b) in enumerate(cut, 1)])
        rows = [[dict(zip(("split_sequence", "content", "overlap", "token_count"), x)) for x in row] for row in rows]
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(names, pa.string()), pa.array(rows, kind)], names=["chunk_id", "boundary", "pieces"])


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_id``, ``boundary`` and ``pieces`` of each chunk of ``chunks(id, content, ...)`` over ``limit`` tokens.

    Pieces are numbered "1/3", hold ``limit`` tokens at most and repeat about ``overlap`` tokens of the piece before
    (less where a segment leaves no room); without their overlaps they are the content but for white space at the cuts.
    Null contents and those within the limit give no row; rows loaded twice count once; further columns are ignored.
    """
    big = chunks.filter(F.length("content") >= (limit + 1) * CHARS).select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    return big.mapInArrow(partial(_split, limit=limit, overlap=overlap), SCHEMA)
