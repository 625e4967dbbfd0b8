"""Problem 7: passages of evaluation items inside a training corpus, by greedy string tiling.

Seeds of ``SEED`` successive words, at every word of documents and items, are joined.  The item's places that a document
hits bound what tiles there can be: a common run of n words hits n - SEED + 1 places in a row, and no tile covers a word
without a hit place.  Only pairs within these bounds are tiled, and only their documents' texts are fetched: the longest
common runs of words not yet marked, found by Karp-Rabin hashes of running length, are marked again and again until none
of ``LEAST`` words is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import U, Words, list_array, mix, slices
from tessera.session import checkpointed, spread

#: Successive words in common that make a leak, words of a seed, and words of the shortest tile that coverage counts.
MATCH, SEED, LEAST = 13, 7, 7
#: Share of an item in tiles that makes a leak.
COVERAGE = 0.5
#: Items whose seeds may be broadcast, and documents whose ids may be, at most; larger sets are joined by a shuffle.
BROADCAST_ITEMS, BROADCAST_IDS = 20_000, 1_000_000


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different seeds of each text."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text").to_pylist())
        seed, first = words.grams(SEED)
        doc = words.doc[first]
        order = np.lexsort((seed, doc))
        seed, doc = seed[order], doc[order]
        new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])))[: len(seed)]
        counts = np.bincount(doc[new], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("key"), list_array(seed[new].view(np.int64), counts, pa.int64())], names=["key", "seeds"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's number of words and the seeds of all its places, in order."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text").to_pylist())
        seed, first = words.grams(SEED)
        counts = np.bincount(words.doc[first], minlength=batch.num_rows)
        size = np.bincount(words.doc, minlength=batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(size), list_array(seed.view(np.int64), counts, pa.int64())], names=["key", "words", "seeds"])


def _longest(a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in ``a`` and ``b`` of the common runs of ``size`` unmarked words, by Karp-Rabin hashes."""
    if min(len(a), len(b)) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    free = [np.flatnonzero(np.convolve(used, np.ones(size, dtype=np.int64), "valid") == 0) for used in (used_a, used_b)]
    hashes = []
    for text, at in zip((a, b), free):
        total = np.zeros(len(at), dtype=U)
        for k in range(size):
            total = total * U(0x100000001B3) + text[at + k]
        hashes.append(mix(total))
    order = np.argsort(hashes[1], kind="stable")
    found = hashes[1][order]
    lo = np.searchsorted(found, hashes[0])
    hit = (lo < len(found)) & (found[np.minimum(lo, max(len(found) - 1, 0))] == hashes[0]) if len(found) else np.zeros(len(hashes[0]), bool)
    return free[0][hit], free[1][order[lo[hit]]]


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word arrays: (start in a, start in b, words), the longest tiles first.

    The greatest length with a common unmarked run is found by doubling and halving, since a run holds all shorter ones.
    """
    used_a, used_b, out = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
    top = min(len(a), len(b)) + 1
    while True:
        low, high = least - 1, top
        step = least
        while step < high and len(_longest(a, b, used_a, used_b, step)[0]):
            low, step = step, step * 2
        high = min(high, step)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if len(_longest(a, b, used_a, used_b, mid)[0]) else (low, mid)
        if low < least:
            return out
        for i, j in zip(*_longest(a, b, used_a, used_b, low)):
            if not used_a[i : i + low].any() and not used_b[j : j + low].any():
                used_a[i : i + low] = used_b[j : j + low] = 1
                out.append((int(i), int(j), int(low)))
        top = low + 1


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        docs, items = Words(batch.column("text").to_pylist()), Words(batch.column("item").to_pylist())
        rows = np.arange(batch.num_rows + 1)
        da, ia = np.searchsorted(docs.doc, rows), np.searchsorted(items.doc, rows)
        longest, covered, share, count = [], [], [], []
        for r in range(batch.num_rows):
            b = items.hash[ia[r] : ia[r + 1]]
            found = tiles(docs.hash[da[r] : da[r + 1]], b)
            longest.append(max((t[2] for t in found), default=0))
            covered.append(sum(t[2] for t in found))
            share.append(covered[-1] / max(len(b), 1))
            count.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array(longest, pa.int32()), pa.array(count, pa.int32()), pa.array(covered, pa.int32()), pa.array(share, pa.float64())],
            names=["doc_id", "item_id", "longest", "tiles", "covered", "coverage"],
        )


def _bounds(places: Column) -> Column:
    """Of the sorted places of an item that a document hits: the longest run of them, and the words they cover."""
    start = F.struct(F.lit(-SEED - 1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("longest"), F.lit(0).alias("covered"))

    def step(s: Column, at: Column) -> Column:
        run = F.when(at == s["last"] + 1, s["run"] + 1).otherwise(1)
        more = F.least(at - s["last"], F.lit(SEED))
        return F.struct(at.alias("last"), run.alias("run"), F.greatest(s["longest"], run).alias("longest"), (s["covered"] + more).alias("covered"))

    return F.aggregate(places, start, step)


def candidates(documents: DataFrame, items: DataFrame, match: int, coverage: float | None) -> DataFrame:
    """``doc_id`` and ``item_id`` of all pairs that can have a tile of ``match`` words or tiles over ``coverage`` of the item."""
    of_doc = spread(documents.select(F.col("doc_id").alias("key"), "text"), "key").mapInArrow(_seeds, "key bigint, seeds array<bigint>")
    of_doc = of_doc.select(F.col("key").alias("doc_id"), F.explode("seeds").alias("seed"))
    of_item = items.select(F.col("item_id").alias("key"), F.col("item").alias("text")).mapInArrow(_item_seeds, "key bigint, words int, seeds array<bigint>")
    of_item = of_item.select(F.col("key").alias("item_id"), "words", F.posexplode("seeds").alias("at", "seed"))
    if few(items):
        of_item = F.broadcast(of_item)  # a document's other seeds leave before any shuffle, and no frequent seed is a key
    hits = of_doc.join(of_item, "seed").groupBy("doc_id", "item_id").agg(F.first("words").alias("words"), F.sort_array(F.collect_set("at")).alias("places"))
    hits = hits.withColumn("b", _bounds(F.col("places")))
    able = F.col("b.longest") >= match - SEED + 1
    if coverage is not None:
        able |= F.col("b.covered") >= F.col("words") * coverage
    return hits.filter(able).select("doc_id", "item_id")


def few(items: DataFrame) -> bool:
    return items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS


def find_leaks(documents: DataFrame, items: DataFrame, match: int = MATCH, coverage: float | None = COVERAGE) -> DataFrame:
    """One row for each document and item with a tile of ``match`` words, or tiles over ``coverage`` of the item, with the tiling's figures.

    Columns: doc_id, item_id, longest (words of the longest tile), tiles, covered (words of the item in tiles), coverage
    (their share).  A ``longest`` of ``match`` is a leak by passage; ``coverage`` also catches passages in another order,
    since tiles may stand anywhere.  ``match`` is at least ``SEED``.  Null, blank and short texts give no row; rows loaded
    twice count once; empty tables give an empty result; further columns are ignored.
    """
    if match < SEED:
        raise ValueError(f"match must be at least {SEED}")
    documents = documents.select("doc_id", "text").filter((F.length("text") > 0) & F.col("doc_id").isNotNull())
    items = items.select("item_id", F.col("text").alias("item")).filter((F.length("item") > 0) & F.col("item_id").isNotNull()).distinct()
    pairs = checkpointed(candidates(documents, items, match, coverage))
    needed = pairs.select("doc_id").distinct()
    # beyond the bound the join is a shuffle, in which Spark's own Bloom filter of the few ids spares most documents
    needed = F.broadcast(needed) if needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else needed
    texts = documents.join(needed, "doc_id", "left_semi").distinct()
    items = F.broadcast(items) if few(items) else items
    # one partition holds few documents, also where one document meets many items
    both = pairs.join(texts, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item").repartition("doc_id", "item_id")
    found = both.mapInArrow(_tile, "doc_id bigint, item_id bigint, longest int, tiles int, covered int, coverage double")
    leak = F.col("longest") >= match
    return found.filter(leak if coverage is None else leak | (F.col("coverage") >= coverage))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id`` and ``item_id`` of texts with ``MATCH`` successive words in common."""
    return find_leaks(documents, items, coverage=None).select("doc_id", "item_id")
