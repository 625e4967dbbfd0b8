"""Problem 2: the most similar vectors of every vector, by low-dimensional stable projections in kd-trees.

Unit vectors are projected on ``DIMS`` Gaussian directions.  A kd-tree fitted on a bounded sample cuts the projected
space into tiles, which Spark spreads over tasks; each tile has its own kd-tree.  A query's projected neighbours are
verified a few leaves at a time, nearest first, until the chi-square test holds: with the distance ``d`` of the k-th
neighbour so far, a vector nearer than ``d`` lies beyond the projected distance ``d * sqrt(quantile)`` with probability
``1 - CONFIDENCE`` at most.  Queries go to their own tile first, then in rounds to ``NEXT`` tiles, ``GROWTH`` times as many
and so on, those first that most likely hold a vector at the distance found so far, until the rest is less likely than ``1 -
TOGETHER``: where such a vector projects to is normal in each direction, which gives the likelihood of a tile's box.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.arrays import U, mix
from tessera.session import checkpointed

#: Directions of projection (even), probability with which a nearer vector is within the tested distance.
DIMS, CONFIDENCE = 8, 0.99
#: Vectors of a tile and of a leaf, about; tiles at least and at most (beyond 4 billion vectors tiles grow).
TILE, LEAF, LEAST_TILES, MOST_TILES = 65_536, 96, 8, 65_536
#: Projections that the tiles' tree is fitted on: at least, and for each tile; at most 33 MB come to the driver.
SAMPLE, SAMPLE_OF_TILE = 16_384, 8
#: Tiles of a query's first round away from home and how many times as many each further round has; likelihood of the
#: tiles asked together; that below which a tile is left out of the sum.
NEXT, GROWTH, TOGETHER, SMALL = 2, 4, 0.999, 1e-5
#: Queries that traverse a tile together.
BLOCK = 256
#: Digits of a similarity that count; vectors that agree in them are ordered by id.
DIGITS = 9


@cache
def chi_square(confidence: float = CONFIDENCE, dims: int = DIMS) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by halving."""
    low, high = 0.0, 200.0
    for _ in range(80):
        half = (low + high) / 4
        tail = math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))
        low, high = (low, 2 * half) if tail < 1 - confidence else (2 * half, high)
    return high


@cache
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMS))


def unit(dense: np.ndarray) -> np.ndarray:
    dense = dense.astype(np.float64)
    return dense / np.linalg.norm(dense, axis=1, keepdims=True)


def kd_leaves(points: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree with medians along the widest dimension."""
    parts = [np.arange(len(points))]
    while len(parts) < leaves:
        new = []
        for rows in parts:
            if len(rows) < 2:
                new.append(rows)
                continue
            dim = np.ptp(points[rows], axis=0).argmax()
            half = len(rows) // 2
            order = rows[np.argpartition(points[rows, dim], half)]
            new += [order[:half], order[half:]]
        parts = new
    return [p for p in parts if len(p)]


class Tree:
    """A kd-tree whose leaves, the tiles, together cover the whole space: medians of ``points`` along the widest dimension."""

    def __init__(self, points: np.ndarray, tiles: int):
        box = np.stack([np.full(DIMS, -np.inf), np.full(DIMS, np.inf)])
        boxes, dims, cuts, children = [box], [-1], [0.0], [(-1, -1)]
        leaves = [(0, np.arange(len(points)))]
        while len(leaves) < tiles:
            new = []
            for node, rows in leaves:
                spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(DIMS)
                dim = int(spread.argmax())
                at = float(np.median(points[rows, dim])) if spread[dim] > 0 else 0.0
                side = points[rows, dim] < at if spread[dim] > 0 else np.zeros(len(rows), dtype=bool)
                if not side.any():
                    new.append((node, rows))
                    continue
                dims[node], cuts[node], children[node] = dim, at, (len(boxes), len(boxes) + 1)
                for edge, part in ((1, rows[side]), (0, rows[~side])):
                    inner = boxes[node].copy()
                    inner[edge, dim] = at
                    new.append((len(boxes), part))
                    boxes.append(inner), dims.append(-1), cuts.append(0.0), children.append((-1, -1))
            if len(new) == len(leaves):
                break
            leaves = new
        self.low, self.high = (np.stack([b[k] for b in boxes]) for k in (0, 1))
        self.dim, self.at, self.child = np.array(dims), np.array(cuts), np.array(children)
        self.tile = np.full(len(boxes), -1)
        self.tile[[node for node, _ in leaves]] = np.arange(len(leaves))
        self.tiles = len(leaves)

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The tile of each point."""
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            on = np.flatnonzero(self.dim[node] >= 0)
            if not len(on):
                return self.tile[node]
            at = node[on]
            node[on] = self.child[at, (points[on, self.dim[at]] >= self.at[at]).astype(int)]

    def likely(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, tile, likelihood that a vector at the squared distance ``bound`` of it lies there), each query's most likely first.

        Such a unit vector is the query's times their cosine and a part at right angles to it, whose projections are normal.
        """
        query, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        cosine = np.maximum(1 - bound / 2, 0.0)
        points, scale = points * cosine[:, None], np.sqrt(np.maximum(1 - cosine**2, 1e-12))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(query):
            p, s = points[query], scale[query, None]
            share = np.prod(normal((self.high[node] - p) / s) - normal((self.low[node] - p) / s), axis=1)
            keep = share >= SMALL
            query, node, share = query[keep], node[keep], share[keep]
            leaf = self.dim[node] < 0
            found.append((query[leaf], self.tile[node[leaf]], share[leaf]))
            query, node = np.repeat(query[~leaf], 2), self.child[node[~leaf]].ravel()
        query, tile, share = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((tile, -share, query))
        return query[order], tile[order], share[order]


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution's function, to seven digits (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-np.minimum(x * x, 700.0))
    return np.where(z < 0, tail / 2, 1 - tail / 2)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0.0) ** 2
    return out


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column as a matrix of as many rows as the column has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


class Tile:
    """Vectors of one tile, their ids, and a kd-tree over their projections."""

    def __init__(self, keys: np.ndarray, dense: np.ndarray, ids: list[list[int]]):
        vectors = unit(dense)
        low = vectors @ _directions(vectors.shape[1])
        leaves = kd_leaves(low, max(1, len(low) // LEAF))
        order = np.concatenate(leaves)
        self.keys, self.vectors = keys[order], vectors[order]
        named = [ids[k] for k in order]
        self.id_edge = np.concatenate(([0], np.cumsum([len(row) for row in named])))
        self.first = np.array([row[0] for row in named], dtype=np.int64)
        self.flat_ids = np.concatenate([np.array(row, dtype=np.int64) for row in named])
        self.edge = np.concatenate(([0], np.cumsum([len(x) for x in leaves])))
        self.low = np.stack([low[x].min(axis=0) for x in leaves])
        self.high = np.stack([low[x].max(axis=0) for x in leaves])

    def search(self, keys: np.ndarray, dense: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and rows of the ``k`` nearest vectors of other keys; -2 and -1 fill up what the test left out."""
        vectors = unit(dense)
        far = box_distance(vectors @ _directions(vectors.shape[1]), self.low, self.high)
        order = np.argsort(far.argmin(axis=1), kind="stable")
        keep = k + 3  # ties of more go by id
        sims, rows = np.full((len(keys), keep), -2.0), np.full((len(keys), keep), -1)
        for at in range(0, len(keys), BLOCK):
            self._block(order[at : at + BLOCK], keys, vectors, far, bound, k, sims, rows)
        return sims, rows

    def _block(self, q: np.ndarray, keys: np.ndarray, vectors: np.ndarray, far: np.ndarray, bound: np.ndarray, k: int, sims: np.ndarray, rows: np.ndarray) -> None:
        rest = np.argsort(far[q].min(axis=0))
        best, at, limit = sims[q], rows[q], bound[q].copy()
        while True:
            open_ = far[np.ix_(q, rest)] <= chi_square() * limit[:, None]
            rest, open_ = rest[open_.any(axis=0)], open_[:, open_.any(axis=0)]
            if not len(rest):
                break
            take, rest = rest[:6], rest[6:]
            who = np.flatnonzero(open_[:, :6].any(axis=1))
            row = np.concatenate([np.arange(self.edge[x], self.edge[x + 1]) for x in take])
            new = vectors[q[who]] @ self.vectors[row].T
            new[keys[q[who], None] == self.keys[row]] = -2.0
            more = new.max(axis=1) >= 1 - limit[who] / 2 - 10.0**-DIGITS  # only these have something within the bound
            who, new = who[more], new[more]
            if not len(who):
                continue
            both = np.concatenate((best[who], new), axis=1)
            index = np.concatenate((at[who], np.broadcast_to(row, new.shape)), axis=1)
            top = np.argpartition(-both, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
            kth = -np.partition(-np.take_along_axis(both, top, axis=1), k - 1, axis=1)[:, k - 1]
            # where more tie with the k-th than are kept, those with the smallest ids stay; each has an id, so k of them are enough
            for r in np.flatnonzero((kth > -1.5) & ((both >= kth[:, None] - 10.0**-DIGITS).sum(axis=1) > top.shape[1])):
                top[r] = np.lexsort((self.first[index[r]], -both[r].round(DIGITS)))[: top.shape[1]]
            best[who], at[who] = np.take_along_axis(both, top, axis=1), np.take_along_axis(index, top, axis=1)
            limit[who] = np.minimum(limit[who], np.maximum(2 - 2 * kth, 0.0) + 1e-9)
        sims[q], rows[q] = best, at


FOUND = "vec bigint, sim double, point_id bigint, bound double"


def _answers(tile: Tile, keys: np.ndarray, dense: np.ndarray, bound: np.ndarray, k: int, home: bool) -> pa.RecordBatch:
    """The ``k`` nearest ids of each query within its bound, and the bound that they leave.

    At ``home`` a query without any gets a row of nulls, so that it is asked elsewhere.
    """
    sims, rows = tile.search(keys, dense, bound, k)
    left = np.minimum(bound, np.maximum(2 + 2 * np.partition(-sims, k - 1, axis=1)[:, k - 1], 0) + 1e-9)
    query, place = np.nonzero((rows >= 0) & (2 - 2 * sims <= left[:, None] + 1e-9))
    sim, row = sims[query, place].round(DIGITS), rows[query, place]
    many = np.minimum(np.diff(tile.id_edge)[row], k)
    index = np.repeat(tile.id_edge[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    query, sim, ids = np.repeat(query, many), np.repeat(sim, many), tile.flat_ids[index]
    order = np.lexsort((ids, -sim, query))
    query, sim, ids = query[order], sim[order], ids[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    query, sim, ids = query[rank < k], sim[rank < k], ids[rank < k]
    none = np.setdiff1d(np.arange(len(keys)), query) if home else np.empty(0, np.int64)
    gone = np.concatenate((np.zeros(len(query), bool), np.ones(len(none), bool)))
    query = np.concatenate((query, none))
    sim, ids = np.concatenate((sim, np.zeros(len(none)))), np.concatenate((ids, np.zeros(len(none), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(keys[query]), pa.array(sim, mask=gone), pa.array(ids, mask=gone), pa.array(left[query])], names=["vec", "sim", "point_id", "bound"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by tile and ``query``: a tile's vectors, then the queries from elsewhere, a batch at a time."""
    name, held, tile = None, [], None

    def own() -> Iterator[pa.RecordBatch]:
        """Builds the tile; if no queries from elsewhere come with it, its own vectors ask."""
        nonlocal tile, held
        part = pa.Table.from_batches(held)
        keys, dense = part["vec"].to_numpy(), _matrix(part["dense"], np.float32)
        tile, held = Tile(keys, dense, part["ids"].to_pylist()), []
        asks = part["asks"].to_numpy(zero_copy_only=False)
        for at in range(0, len(keys), 4096):
            rows = slice(at, at + 4096)
            mine = np.flatnonzero(asks[rows]) + at
            if len(mine):
                yield _answers(tile, keys[mine], dense[mine], np.full(len(mine), 4.0), k, True)

    for batch in batches:
        tiles, query = batch.column("tile").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(query.astype(int)) != 0)) + 1
        for a, b in zip([0, *change], [*change, len(tiles)]):
            if a == b:
                continue
            if tiles[a] != name:
                if held:
                    yield from own()
                name, tile = tiles[a], None
            part = batch.slice(a, b - a)
            if not query[a]:
                held.append(part)
                continue
            if held:
                yield from own()
            if tile is not None:
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    yield _answers(tile, some.column("vec").to_numpy(), _matrix(some.column("dense"), np.float32), some.column("bound").to_numpy(), k, False)
    if held:
        yield from own()


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            dense = _matrix(batch.column("dense"), np.float32)
            low = unit(dense) @ _directions(dense.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.list_(pa.float64()))], names=["low"])


def _assign(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Adds the tile of each vector."""
    for batch in batches:
        if batch.num_rows:
            dense = _matrix(batch.column("dense"), np.float32)
            tile = tree.locate(unit(dense) @ _directions(dense.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), *batch.columns], names=["tile", *batch.schema.names])


def further(tree: Tree, points: np.ndarray, bound: np.ndarray, seen: list[set[int]], most: int) -> list[list[int]]:
    """The tiles of each query's next round: ``most`` at most, those at home and ``seen`` left out."""
    query, tile, share = tree.likely(points, bound)
    if not len(query):
        return [[] for _ in seen]
    before = np.cumsum(share) - share
    keep = before - before[np.searchsorted(query, query)] < TOGETHER
    keep &= tile != tree.locate(points)[query]
    out: list[list[int]] = [[] for _ in seen]
    for q, t in zip(query[keep].tolist(), tile[keep].tolist()):
        if len(out[q]) < most and t not in seen[q]:
            out[q].append(t)
    return out


STATE = "vec bigint, bound double, sims array<double>, seen array<int>"


def _plan(batches: Iterator[pa.RecordBatch], tree: Tree, most: int) -> Iterator[pa.RecordBatch]:
    """Of the queries (vec, bound, sims, seen, dense) those that go on, with the ``tiles`` of the next round."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dense = _matrix(batch.column("dense"), np.float32)
        points = unit(dense) @ _directions(dense.shape[1])
        for at in range(0, len(points), 1024):
            some = batch.slice(at, 1024)
            tiles = further(tree, points[at : at + 1024], some.column("bound").to_numpy(), [set(x) for x in some.column("seen").to_pylist()], most)
            on = pa.array([k for k, t in enumerate(tiles) if t], pa.int64())
            tiles = pa.array([t for t in tiles if t], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*some.select(["vec", "bound", "sims", "seen"]).take(on).columns, tiles], names=["vec", "bound", "sims", "seen", "tiles"])


def valid_points(points: DataFrame) -> DataFrame:
    """``point_id`` and ``dense`` of the latest row of each id, if it has 64 finite numbers that aren't all zero."""
    latest = points.groupBy("point_id").agg(F.max(F.struct("upserted_at", "dense")).alias("row")).select("point_id", "row.dense")
    bad = F.exists("dense", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.filter(F.col("point_id").isNotNull() & (F.size("dense") == 64) & ~bad & F.exists("dense", lambda x: x != 0))


def _directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``vec``, a hash of the vector's direction, finer than the digits of a similarity that count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        direction = np.rint(unit(_matrix(batch.column("dense"), np.float32)) * 1e13).astype(np.int64).view(U)
        total = np.zeros(batch.num_rows, dtype=U)
        for d in range(direction.shape[1]):
            total = mix(total * U(0x100000001B3) + direction[:, d])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total.view(np.int64))], names=["point_id", "dense", "vec"])


def nearest(points: DataFrame, k: int = 5) -> DataFrame:
    """``point_id``, ``neighbour_id``, ``similarity`` of the ``k`` other points most similar to each, by cosine.

    Equal similarities (to nine digits) go to the smaller id.  Rows of ``points(point_id, dense, upserted_at)`` with a
    null or unusable vector take no part; of several rows of an id the latest counts.  With ``k`` points or fewer, all
    others come out; one point or none gives an empty result.  Copies of a vector, at whatever length, are searched once.
    """
    points = checkpointed(valid_points(points).select("point_id", "dense").mapInArrow(_directed, "point_id bigint, dense array<float>, vec bigint"))
    first = F.row_number().over(Window.partitionBy("vec").orderBy("point_id"))
    vectors = points.withColumn("n", first).filter(F.col("n") <= k + 1)
    vectors = vectors.groupBy("vec").agg(F.first("dense").alias("dense"), F.sort_array(F.collect_list("point_id")).alias("ids"))
    vectors = checkpointed(vectors)
    tiles = min(MOST_TILES, max(LEAST_TILES, math.ceil(vectors.count() / TILE)))
    sample = vectors.orderBy(F.xxhash64("vec")).select("dense").limit(max(SAMPLE, SAMPLE_OF_TILE * tiles)).mapInArrow(_project, "low array<double>").toArrow()["low"]
    tree = Tree(_matrix(sample, np.float64) if len(sample) else np.zeros((1, DIMS)), tiles)

    columns = "tile int, vec bigint, dense array<float>, ids array<bigint>"
    placed = checkpointed(vectors.mapInArrow(partial(_assign, tree=tree), columns))
    none = F.lit(None).cast("double").alias("bound")
    data = placed.select("tile", F.lit(False).alias("query"), "vec", "dense", "ids", F.lit(True).alias("asks"), none)

    def search(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(tree.tiles, "tile").sortWithinPartitions("tile", "query").mapInArrow(partial(_search, k=k), FOUND)

    sims = F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, k)
    found = [checkpointed(search(data))]
    state = found[0].groupBy("vec").agg(F.min("bound").alias("bound"), sims.alias("sims")).withColumn("seen", F.array().cast("array<int>"))
    most = NEXT
    while most < GROWTH * tree.tiles:  # a round for each power of GROWTH up to the number of tiles
        plan = state.join(vectors.select("vec", "dense"), "vec").select("vec", "bound", "sims", "seen", "dense")
        plan = checkpointed(plan.mapInArrow(partial(_plan, tree=tree, most=most), f"{STATE}, tiles array<int>"))
        if plan.isEmpty():
            break
        asking = plan.select("vec", "bound", F.explode("tiles").alias("tile")).join(vectors.select("vec", "dense"), "vec")
        asking = asking.select("tile", F.lit(True).alias("query"), "vec", "dense", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(True).alias("asks"), "bound")
        found.append(checkpointed(search(data.withColumn("asks", F.lit(False)).union(asking))))
        new = found[-1].groupBy("vec").agg(F.min("bound").alias("new_bound"), sims.alias("new_sims"))
        merged = F.slice(F.sort_array(F.concat("sims", F.coalesce("new_sims", F.array().cast("array<double>"))), asc=False), 1, k)
        state = plan.join(new, "vec", "left").select("vec", F.least("bound", "new_bound").alias("bound"), merged.alias("sims"), F.concat("seen", "tiles").alias("seen"))
        kth = F.greatest(2 - 2 * F.try_element_at("sims", F.lit(k)), F.lit(0.0)) + 1e-9
        state = state.withColumn("bound", F.least("bound", kth))
        most *= GROWTH
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    found = rows.filter(F.col("point_id").isNotNull()).select("vec", "sim", "point_id")

    own = vectors.select("vec", F.lit(1.0).alias("sim"), F.explode("ids").alias("point_id"))
    rank = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("sim").desc(), "point_id"))
    best = found.union(own).withColumn("n", rank).filter(F.col("n") <= k + 1)
    best = best.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "point_id"))).alias("best"))
    mine = points.select("point_id", "vec").join(best, "vec")
    others = F.slice(F.filter("best", lambda x: x["point_id"] != F.col("point_id")), 1, k)
    return mine.select("point_id", F.explode(others).alias("x")).select(
        "point_id", F.col("x.point_id").alias("neighbour_id"), (-F.col("x.far")).alias("similarity")
    )


def similar_point_pairs(points: DataFrame, k: int = 5) -> DataFrame:
    """``point_a < point_b``, at least one of which is among the other's ``k`` most similar."""
    found = nearest(points, k)
    return found.select(F.least("point_id", "neighbour_id").alias("point_a"), F.greatest("point_id", "neighbour_id").alias("point_b")).distinct()
