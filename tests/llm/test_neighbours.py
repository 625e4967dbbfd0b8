import datetime
import random

import numpy as np
import pytest
from helpers import rows

from tessera.llm import neighbours as N

T = [datetime.datetime(2025, 1, k) for k in (1, 2, 3)]
SCHEMA = "point_id bigint, collection_name string, dense array<float>, upserted_at timestamp, vec int"


def truth(vectors, k=5):
    ids = np.array(sorted(vectors))
    u = N.unit(np.stack([vectors[i] for i in ids]))
    sim = (u @ u.T).round(N.DIGITS)
    out = {}
    for a, i in enumerate(ids):
        order = [int(ids[b]) for b in np.lexsort((ids, -sim[a])) if b != a][:k]
        out[int(i)] = order
    return out


def cluster(seed, n, size=64):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((max(1, n // 12), size))
    return {k + 1: (centres[k % len(centres)] + 0.25 * g.standard_normal(size)).astype(np.float32) for k in range(n)}


def test_recall_and_copies(spark):
    vectors = cluster(1, 900)
    for k in range(40):  # a group of copies larger than k, and scaled ones
        vectors[2000 + k] = vectors[7].copy()
        vectors[3000 + k] = (vectors[9] * 4).astype(np.float32)
    data = [(i, "c", v.tolist(), T[0], 0) for i, v in vectors.items()]
    random.Random(1).shuffle(data)
    found = {}
    for r in N.nearest(spark.createDataFrame(data, SCHEMA)).collect():
        found.setdefault(r.point_id, set()).add(r.neighbour_id)
    expected = truth(vectors)
    hits = sum(len(found[i] & set(expected[i])) for i in expected)
    assert hits >= 0.98 * 5 * len(expected) and all(len(v) == 5 for v in found.values())
    for k in (0, 20, 39):
        assert found[2000 + k] == set(expected[2000 + k])


def test_ties_of_many_directions_and_lengths(spark):
    """More different arrays tie than a tile keeps: the smaller ids come first."""
    at = np.eye(64, dtype=np.float32)
    near = {1000 - k: at[0] + at[k] for k in range(1, 41)}  # all as similar to the first direction
    tile = N.Tile(np.arange(len(near)), np.stack(list(near.values())), [[i] for i in near])
    batch = N._answers(tile, np.array([-1]), at[:1], np.array([4.0]), 5, True)
    assert batch.column("point_id").to_pylist() == sorted(near)[:5]
    g = np.random.default_rng(5)
    lines = {100 * j + 60 - s: v * s for j, v in enumerate(g.integers(-4, 5, (6, 64)).astype(np.float32)) for s in range(1, 41)}
    found = {}
    for r in N.nearest(spark.createDataFrame([(i, "c", v.tolist(), T[0], 0) for i, v in lines.items()], SCHEMA)).collect():
        found.setdefault(r.point_id, []).append(r.neighbour_id)
    expected = truth(lines)
    assert {i: sorted(v) for i, v in found.items()} == expected


def test_odd_points(spark):
    v = cluster(2, 3)
    bad = [None, [0.0] * 64, [float("nan")] * 64, [1.0] * 63, [float("inf")] + [1.0] * 63]
    data = [(i, "c", x.tolist(), T[0], 0) for i, x in v.items()] * 2
    data += [(10 + k, "c", x, T[0], 0) for k, x in enumerate(bad)]
    data += [(1, "c", v[2].tolist(), T[2], 0), (1, "c", None, T[1], 0), (2, "c", v[2].tolist(), None, 0)]
    data += [(20, "c", v[3].tolist(), T[0], 0), (20, "c", None, T[1], 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(N.similar_point_pairs(df)) == [(1, 2), (1, 3), (2, 3)]
    assert rows(N.nearest(df, 1), "point_id", "neighbour_id", "similarity")[:2] == [(1, 2, 1.0), (2, 1, 1.0)]
    for few in (df.limit(0), df.filter("point_id = 3")):
        assert N.nearest(few).count() == 0


def test_chi_square():
    assert N.chi_square(0.95, 8) == pytest.approx(15.507, abs=1e-3) and N.chi_square(0.99, 2) == pytest.approx(9.210, abs=1e-3)


def test_tree():
    g = np.random.default_rng(3)
    points = g.standard_normal((3000, N.DIMS))
    tree = N.Tree(points, 64)
    assert tree.tiles == 64 and np.bincount(tree.locate(points), minlength=64).min() > 30
    leaf = {t: n for n, t in enumerate(tree.tile) if t >= 0}
    for p, tile in zip(points[:200], tree.locate(points[:200])):
        assert (tree.low[leaf[tile]] <= p).all() and (p < tree.high[leaf[tile]]).all()
    query, tile, share = tree.likely(points[:50], np.full(50, 0.3))
    for q in range(50):  # as often as offsets of that size end there
        ends = np.bincount(tree.locate(0.85 * points[q] + np.sqrt(1 - 0.85**2) * g.standard_normal((4000, N.DIMS))), minlength=64) / 4000
        mine = np.zeros(64)
        mine[tile[query == q]] = share[query == q]
        assert np.abs(mine - ends).max() < 0.05
    same = N.Tree(np.ones((10, N.DIMS)), 8)
    assert same.tiles == 1 and same.locate(points).max() == 0
    assert N.normal(np.array([-9.0, 0.0, 1.96, np.inf, -np.inf])).round(4).tolist() == [0, 0.5, 0.975, 1, 0]


KINDS = {
    "isotropic": lambda g, n: g.standard_normal((n, 64)),
    "loose clusters": lambda g, n: g.standard_normal((n // 20, 64))[g.integers(0, n // 20, n)] + 0.7 * g.standard_normal((n, 64)),
    "low rank": lambda g, n: g.standard_normal((n, 5)) @ g.standard_normal((5, 64)) + 0.05 * g.standard_normal((n, 64)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_recall_over_many_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "LEAST_TILES", 64)
    made = KINDS[kind](np.random.default_rng(9), 3000).astype(np.float32)
    vectors = {k: v for k, v in enumerate(made)}
    found = {}
    for r in N.nearest(spark.createDataFrame([(i, "c", v.tolist(), T[0], 0) for i, v in vectors.items()], SCHEMA)).collect():
        found.setdefault(r.point_id, set()).add(r.neighbour_id)
    expected = truth(vectors)
    hits = sum(len(found[i] & set(expected[i])) for i in expected)
    assert hits >= 0.97 * 5 * len(expected)
