"""Problem 4: texts that differ by small edits, by a self-join of binary tries of fingerprints.

A fingerprint is made of minimum hashes of a text's shingles: two bits of each of ``WIDTH`` of them, so that the Hamming
distance of two fingerprints estimates the share of shingles that differ.  A trie over all fingerprints would be joined
with an error budget so wide that its top is met whole; therefore the fingerprint is rotated ``turns`` times, each time
beginning with the full values of ``LEAD`` other minimum hashes, on which no error is allowed.  Spark gathers the texts
below one such beginning; there the trie is traversed in node pairs, a byte of the fingerprint at a time, differing bits
are added up, and a pair of nodes ends where they exceed the budget.  A pair of texts at the threshold survives some
rotation but for the probability ``MISS``.  The pairs found are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import U, Words, list_array, mix, slices
from tessera.session import checkpointed, spread

#: Minimum hashes that begin a rotation, and those that give two bits each to the fingerprint.
LEAD, WIDTH = 3, 96
#: Probability that a pair at the threshold is missed by all rotations.
MISS = 1e-5
#: Standard deviations of the distance that the budget leaves to pairs at the threshold.
SPREAD = 4.0
#: Texts below one beginning that a task joins at once; more are joined in pairs of blocks of this size, by many tasks.
BLOCK = 1024
#: Ids that may be broadcast, at most.
BROADCAST_IDS = 1_000_000
#: Texts that a task remembers to count copies once, at most; beyond it the memory is started anew.
REMEMBER = 1_000_000


def turns(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**LEAD))


def budget(threshold: float) -> int:
    """Bits in which fingerprints at the threshold differ, and SPREAD standard deviations more."""
    differ = 1 - threshold
    return math.ceil(WIDTH * differ + SPREAD * math.sqrt(WIDTH * (1.5 * differ - differ * differ)))


@cache
def _multipliers(count: int) -> np.ndarray:
    return (mix(np.arange(1, count + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)


def min_hashes(texts: list[str], shingle: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts with a shingle, and their minimum hashes, one row for each hash function."""
    words = Words(texts)
    grams, first = words.grams(shingle)
    doc = words.doc[first]
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    out = np.empty((count, len(begin)), dtype=np.uint32)
    if len(begin):
        low, high = grams.astype(np.uint32), (grams >> U(32)).astype(np.uint32)
        for k, a in enumerate(_multipliers(count)):
            value = low * a
            value ^= high  # else all functions would order by multiples of one number
            out[k] = np.minimum.reduceat(value * a, begin)
    return doc[begin], out


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, rotations: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # exact copies within a task count once
    for batch in slices(batches, "content"):
        if len(seen) > REMEMBER:
            seen.clear()
        ids, texts, keep = batch.column("tid").to_pylist(), batch.column("content"), []
        for k, tid in enumerate(ids):
            if tid not in seen:
                seen.add(tid)
                keep.append(k)
        rows, values = min_hashes(texts.take(pa.array(keep, pa.int64())).to_pylist(), shingle, max(rotations * LEAD, WIDTH))
        if not len(rows):
            continue
        tid = np.array(ids, dtype=np.int64)[keep][rows]
        two = (mix(values[:WIDTH].astype(U)) & U(3)) << ((np.arange(WIDTH, dtype=U) % U(32)) * U(2))[:, None]
        bits = [np.bitwise_or.reduce(two[k : k + 32]).view(np.int64) for k in range(0, WIDTH, 32)]
        salt = batch.column("salt").to_numpy()[keep][rows].view(U)  # texts of other sources don't meet
        key = np.broadcast_to(salt, (rotations, len(rows)))
        for k in range(LEAD):
            key = mix(key * U(0x9E3779B97F4A7C15) + values[k : rotations * LEAD : LEAD] + np.arange(1, rotations + 1, dtype=U)[:, None])
        columns = [key.ravel().view(np.int64), np.tile(tid, rotations), *(np.tile(b, rotations) for b in bits)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "tid", *BITS])


def _repeat(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count-1 for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def trie_join(group: np.ndarray, bits: np.ndarray, most: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose ``bits`` (bytes, one row each) differ in at most ``most`` bits.

    With ``side`` (False or True) only pairs of rows of different sides.  All groups are traversed together: a node is
    a range of the sorted rows that agree in group and leading bytes, a level is a byte.
    """
    order = np.lexsort((*bits.T[::-1], group))
    group, bits = group[order], bits[order]
    n, depth = len(order), bits.shape[1]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    starts = np.append(np.flatnonzero(new), n)
    x = y = np.flatnonzero(np.diff(starts) > 1)
    error = np.zeros(len(x), dtype=np.int64)
    for level in range(depth):
        new = new | np.concatenate(([True], bits[1:, level] != bits[:-1, level]))
        below = np.append(np.flatnonzero(new), n)
        child = np.searchsorted(below, starts)  # first child of each node
        many = np.diff(child)
        cx, cy = many[x], many[y]
        k = _repeat(cx * cy)
        across = np.repeat(cy, cx * cy)
        a, b = np.repeat(child[x], cx * cy) + k // across, np.repeat(child[y], cx * cy) + k % across
        value = bits[below[:-1], level]
        error = np.repeat(error, cx * cy) + np.bitwise_count(value[a] ^ value[b])
        single = np.diff(below) == 1
        go = (error <= most) & (a <= b) & ~((a == b) & single[a])
        x, y, error, starts = a[go], b[go], error[go], below
    size = np.diff(starts)
    k = _repeat(size[x] * size[y])
    across = np.repeat(size[y], size[x] * size[y])
    a, b = np.repeat(starts[x], size[x] * size[y]) + k // across, np.repeat(starts[y], size[x] * size[y]) + k % across
    a, b = order[a[a < b]], order[b[a < b]]
    if side is not None:
        other = side[a] != side[b]
        a, b = a[other], b[other]
    return a, b


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges between ``n`` rows those of a spanning forest, and each row's component."""
    label, tree = np.arange(n), np.zeros(len(a), dtype=bool)
    while True:
        across = np.flatnonzero(label[a] != label[b])
        if not len(across):
            return np.flatnonzero(tree), label
        first = np.full(n, len(a))  # the first edge out of each component; no cycle can come of these
        np.minimum.at(first, label[a[across]], across)
        np.minimum.at(first, label[b[across]], across)
        new = np.unique(first[first < len(a)])
        tree[new] = True
        while True:
            x, y = label[a[new]], label[b[new]]
            least = label.copy()
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            least = least[label]
            while (least[least] != least).any():
                least = least[least]
            if (least == label).all():
                break
            label = least


BITS = [f"bits_{k}" for k in range(WIDTH // 32)]
PAIRS = "a bigint, b bigint, key bigint, block int, " + ", ".join(f"{b} bigint" for b in BITS)


def _pairs(tid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(tid[a], tid[b]), np.maximum(tid[a], tid[b])
    none = pa.nulls(len(low), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), none, pa.nulls(len(low), pa.int32()), *[none] * len(BITS)], names=["a", "b", "key", "block", *BITS])


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.T).view(np.uint8)


def _join_buckets(rows: np.ndarray, most: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of whole buckets; rows: key, tid and the parts of the fingerprint, sorted by key.

    With ``forest`` the pairs of a spanning forest of each bucket, and the rows of those with further pairs in block 0.
    """
    if not rows.shape[1]:
        return
    edge = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1], [True])))
    size = np.diff(edge)
    keep = np.repeat(size > 1, size)
    rows = rows[:, keep]
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    rows = rows[:, np.concatenate(([True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))[: rows.shape[1]]]
    if rows.shape[1] < 2:
        return
    edge = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1], [True])))
    work = np.cumsum(np.diff(edge) ** 2) // (4 * BLOCK * BLOCK)  # pairs that are held at once
    cut = np.concatenate(([0], np.flatnonzero(np.diff(work)) + 1, [len(work)]))
    for p, q in zip(cut, cut[1:]):
        part = rows[:, edge[p] : edge[q]]
        a, b = trie_join(part[0], _bytes(part[2:]), most)
        if forest and len(a):
            tree, label = spanning(part.shape[1], a, b)
            more = np.bincount(label, minlength=part.shape[1])[label] > 2
            if more.any():
                yield _deferred(part[:, more], np.zeros(more.sum(), np.int64))
            a, b = a[tree], b[tree]
        if len(a):
            yield _pairs(part[1], a, b)


def _deferred(rows: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0]), pa.array(block.astype(np.int32)), *map(pa.array, rows[2:])]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "block", *BITS])


def _buckets(batches: Iterator[pa.RecordBatch], most: int, forest: bool = False) -> Iterator[pa.RecordBatch]:
    """Joins each bucket of a partition sorted by key; the rows of one over BLOCK texts come out with block numbers."""
    carry, over, given = np.empty((2 + len(BITS), 0), dtype=np.int64), None, 0

    def defer(rows: np.ndarray) -> pa.RecordBatch:
        nonlocal given
        block = (given + np.arange(rows.shape[1])) // BLOCK
        given += rows.shape[1]
        return _deferred(rows, block)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if over is not None:
            k = np.searchsorted(rows[0], over, side="right")
            if k:
                yield defer(rows[:, :k])
            rows = rows[:, k:]
            if not rows.shape[1]:
                continue
            over, given = None, 0
        rows = np.concatenate((carry, rows), axis=1)
        last = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
        # buckets that ended within this batch but are too large go the same way as those that go on
        edge = np.flatnonzero(np.concatenate(([True], rows[0, 1:last] != rows[0, : max(last - 1, 0)], [True]))) if last else np.array([0])
        for k in np.flatnonzero(np.diff(edge) > BLOCK):
            big = rows[:, edge[k] : edge[k + 1]]
            given = 0
            yield from _sized(big, most, forest, defer)
        small = np.repeat(np.diff(edge) <= BLOCK, np.diff(edge)) if last else np.zeros(0, bool)
        yield from _join_buckets(rows[:, :last][:, small], most, forest)
        carry = rows[:, last:]
        if carry.shape[1] > BLOCK:
            carry = carry[:, np.unique(carry[1], return_index=True)[1]]
            if carry.shape[1] > BLOCK:
                given, over = 0, carry[0, 0]
                yield defer(carry)
                carry = carry[:, :0]
    given = 0
    yield from _sized(carry, most, forest, defer)


def _sized(rows: np.ndarray, most: int, forest: bool, defer) -> Iterator[pa.RecordBatch]:
    """One whole bucket: joined here, or deferred if it holds more than BLOCK different texts."""
    if rows.shape[1] > BLOCK:
        rows = rows[:, np.unique(rows[1], return_index=True)[1]]
    if rows.shape[1] > BLOCK:
        yield defer(rows)
    else:
        yield from _join_buckets(rows, most, forest)


def _blocks(batches: Iterator[pa.RecordBatch], most: int, forest: bool = False) -> Iterator[pa.RecordBatch]:
    """Joins pairs of blocks; rows are key, pair (x, y), own block, tid, group and the parts of the fingerprint, sorted by key and pair.

    With ``forest`` the pairs of a spanning forest only; of rows with groups the pairs of different groups only.
    """
    carry: list[np.ndarray] = []

    def join(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        (_, x, y, block, tid, group), bits = rows[:6], rows[6:]
        if (group == group[0]).all():
            return
        a, b = trie_join(np.zeros_like(tid), _bytes(bits), most, None if x[0] == y[0] else block == y)
        a, b = a[group[a] != group[b]], b[group[a] != group[b]]
        if forest and len(a):
            tree, _ = spanning(len(tid), a, b)
            a, b = a[tree], b[tree]
        yield _pairs(tid, a, b)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        change = np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0)) + 1
        for part in np.split(rows, change, axis=1):
            if carry and part.shape[1] and (carry[-1][:3, 0] != part[:3, 0]).any():
                yield from join(np.concatenate(carry, axis=1))
                carry = []
            if part.shape[1]:
                carry.append(part)
    if carry:
        yield from join(np.concatenate(carry, axis=1))


def _bucketed(texts: DataFrame, shingle: int, threshold: float, forest: bool) -> DataFrame:
    """Pairs of the buckets that fit a task, and, with a null ``b``, the rows of those that don't, with block numbers."""
    schema = "key bigint, tid bigint, " + ", ".join(f"{b} bigint" for b in BITS)
    prints = texts.mapInArrow(partial(_fingerprints, shingle=shingle, rotations=turns(threshold)), schema)
    return checkpointed(prints.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_buckets, most=budget(threshold), forest=forest), PAIRS).distinct())


def _of_blocks(rows: DataFrame, others: Column, threshold: float, forest: bool = False) -> DataFrame:
    """Pairs of rows(key, a, block, last, group, ...) of different groups, of a block and each of the ``others``."""
    blocks = rows.select("key", F.col("a").alias("tid"), *BITS, "block", "group", F.explode(others).alias("other"))
    blocks = blocks.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "tid", "group", *BITS)
    blocks = blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return blocks.mapInArrow(partial(_blocks, most=budget(threshold), forest=forest), PAIRS).select("a", "b")


def candidates(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of different text ids of ``texts(tid, salt, content)`` of equal salt whose fingerprints are near."""
    found = _bucketed(texts, shingle, threshold, False)
    hot = found.filter(F.col("b").isNull())
    hot = hot.join(hot.groupBy("key").agg(F.max("block").alias("last")), "key")
    more = _of_blocks(hot.withColumn("group", F.col("a")), F.sequence(F.lit(0), "last"), threshold)
    return found.filter(F.col("b").isNotNull()).select("a", "b").union(more).distinct()


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "content"):
        words = Words(batch.column("content").to_pylist())
        grams, first = words.grams(shingle)
        doc, grams = words.doc[first], grams.view(np.int64)
        order = np.lexsort((grams, doc))
        doc, grams = doc[order], grams[order]
        new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(grams) != 0)))[: len(doc)]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), list_array(grams[new], np.bincount(doc[new], minlength=batch.num_rows), pa.int64())], names=["tid", "grams"])


def similar_texts(rows: DataFrame, shingle: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members and links of ``rows(src, id, content)``.

    Members: src, id, tid, one row for each id; exact copies share a ``tid``.  Links: a, b (tids of one src, a <= b) and
    similarity, the share of common different shingles; ``a = b`` stands for a text that has copies.  Texts with
    fewer words than a shingle are in no link.  Null contents are in neither; rows loaded twice count once.
    """
    rows = rows.filter(F.col("content").isNotNull()).select("src", "id", F.xxhash64("src", "content").alias("tid"), "content")
    members = rows.select("src", "id", "tid").distinct()
    texts = spread(rows, "src", "id").select("tid", F.xxhash64("src").alias("salt"), "content")
    pairs = checkpointed(candidates(texts, shingle, threshold))
    copies = members.groupBy("tid").count().filter("count > 1").select("tid")
    return members, compared(pairs, rows, shingle, threshold, copies)


def compared(pairs: DataFrame, rows: DataFrame, shingle: int, threshold: float, copies: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts in ``rows(tid, content)`` are similar, and a link of each of the ``copies(tid)`` with a shingle to itself."""
    needed = pairs.select(F.col("a").alias("tid")).union(pairs.select("b"))
    needed = checkpointed((needed if copies is None else needed.union(copies)).distinct())
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.select("tid", "content").join(F.broadcast(needed) if few else needed, "tid", "left_semi").dropDuplicates(["tid"])
    sets = checkpointed(texts.mapInArrow(partial(_sets, shingle=shingle), "tid bigint, grams array<bigint>"))
    sets = sets.filter(F.size("grams") > 0)
    left, right = (sets.select(F.col("tid").alias(c), F.col("grams").alias(f"grams_{c}"), F.size("grams").alias(f"size_{c}")) for c in "ab")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    links = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b"))
        .select("a", "b", (common / (F.col("size_a") + F.col("size_b") - common)).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )
    if copies is not None:
        links = links.union(copies.join(sets, "tid", "left_semi").select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(1.0).alias("similarity")))
    return checkpointed(links)


def similar_pairs(rows: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``src``, ``id_a < id_b`` of all ids whose contents are similar, copies included."""
    members, links = similar_texts(rows, shingle, threshold)
    a = members.select(F.col("tid").alias("a"), "src", F.col("id").alias("id_1"))
    b = members.select(F.col("tid").alias("b"), F.col("id").alias("id_2"))
    pairs = links.join(a, "a").join(b, "b").filter((F.col("a") != F.col("b")) | (F.col("id_1") < F.col("id_2")))
    return pairs.select("src", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))


def group_links(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links ``a``, ``b`` between texts of ``texts(tid, salt, content)`` that join the same groups as all links would.

    A group of many variants of a text has links in the order of its texts, not of its pairs.  First each bucket gives a
    spanning forest of its near fingerprints, a large one of its blocks with the first, and these pairs are compared.
    Then only pairs whose ends are still in different groups are; whatever the first round left out is among them.
    """
    found = _bucketed(texts, shingle, threshold, True)
    rest = found.filter(F.col("b").isNull())
    rest = checkpointed(rest.join(rest.groupBy("key").agg(F.max("block").alias("last")), "key"))
    hot = _of_blocks(rest.filter("last > 0").withColumn("group", F.col("a")), F.array_distinct(F.array(F.lit(0), "block")), threshold, True)
    pairs = found.filter(F.col("b").isNotNull()).select("a", "b").union(hot).distinct()
    first = compared(checkpointed(pairs), texts, shingle, threshold).select("a", "b")
    named = components(first).select(F.col("tid").alias("a"), F.col("group_id").alias("group"))
    rest = rest.join(named, "a", "left").withColumn("group", F.coalesce("group", "a"))
    open_ = rest.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("key")
    rest = rest.join(open_, "key", "left_semi")
    pairs = checkpointed(_of_blocks(rest, F.sequence(F.lit(0), "last"), threshold).distinct())
    return first.union(compared(pairs, texts, shingle, threshold).select("a", "b"))


def similar_groups(rows: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each id: ``src``, ``id``, ``group_id``, the least id of its group, and ``members``, the ids of the group.

    A group holds the ids of one src that are linked over any number of similar texts; an id without similar ones is
    a group of its own, and so are the copies of a text without a shingle.  Null contents give no row; rows loaded twice
    count once; an id with two contents counts as one member of each one's group.
    """
    rows = rows.filter(F.col("content").isNotNull()).select("src", "id", F.xxhash64("src", "content").alias("tid"), "content")
    members = rows.select("src", "id", "tid").distinct()
    texts = spread(rows, "src", "id").select("tid", F.xxhash64("src").alias("salt"), "content")
    named = members.join(components(group_links(texts, shingle, threshold)), "tid", "left").select("src", "id", F.coalesce("group_id", "tid").alias("g"))
    named = checkpointed(named)
    sizes = named.groupBy("src", "g").agg(F.min("id").alias("group_id"), F.count("*").alias("members"))
    return named.join(sizes, ["src", "g"]).select("src", "id", "group_id", "members")


def components(edges: DataFrame) -> DataFrame:
    """``tid`` and ``group_id``, the least id of its connected component, of every end of ``edges(a, b)``.

    Large and small stars in turn: each node hands its larger neighbours, then its smaller ones, to its least neighbour,
    until nothing changes; that takes a number of rounds in the order of the logarithm of the largest component.
    """
    edges, before = edges.filter("a <> b"), None
    while True:
        for large in (True, False):
            both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            joined = both.join(least, "a")
            if large:
                edges = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                edges = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
            edges = edges.filter("a <> b").distinct()
        edges = checkpointed(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("tid"), F.col("b").alias("group_id")).distinct()
    return edges.select(F.col("a").alias("tid"), F.col("b").alias("group_id")).union(roots)
