import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import leakage as L


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 2), max_size=25))
def test_tiles(a, b):
    x, y = (np.array(v, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) for v in (a, b))
    found = L.tiles(x, y, 3)
    assert (found[0][2] if found else 0) == (longest(a, b) if longest(a, b) >= 3 else 0)
    assert all((x[i : i + n] == y[j : j + n]).all() for i, j, n in found)
    for side in (0, 1):
        spots = [k for t in found for k in range(t[side], t[side] + t[2])]
        assert len(spots) == len(set(spots))


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = {k: [r.choice(vocabulary) for _ in range(r.choice((8, 13, 30)))] for k in range(12)}
    docs = {}
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice((0, 5, 40, 90)))]
        if k % 2:
            source = items[r.randrange(12)]
            n = r.choice((12, 13, 14, 30))
            at = r.randrange(max(1, len(source) - n + 1))
            words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs[k] = words
    df = spark.createDataFrame([(k, ", ".join(v).upper(), 1) for k, v in docs.items()] + [(99, None, 1), (98, "", 1)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(50, None), (51, " "), (7, " ".join(items[7])), (52, " ".join(items[7]))], "item_id bigint, text string")
    expected = {(d, i) for d, w in docs.items() for i, v in items.items() if longest(w, v) >= 13}
    expected |= {(d, 52) for d, i in expected if i == 7}
    assert expected
    assert {tuple(x) for x in L.leaked(df, bench).collect()} == expected
    assert L.leaked(df, bench.limit(0)).count() == 0 and L.leaked(df.limit(0), bench).count() == 0


def test_passages_in_another_order(spark):
    words = [f"w{k}" for k in range(40)]
    df = spark.createDataFrame([(1, " ".join([*words[30:40], "and", *words[10:20], "or", *words[20:30], "so", *words[:10]]))], "doc_id bigint, text string")
    row = L.find_leaks(df.withColumn("item", F.lit(1)), spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")).first()
    assert (row.longest, row.tiles, row.coverage) == (10, 4, 1.0)


def test_short_runs_at_every_place(spark, monkeypatch):
    """Runs of seven words, too short for each seventh word's seed to be sure of them."""
    words = [f"w{k}" for k in range(28)]
    runs = [words[21:], words[7:14], words[14:21], words[:7]]
    data = [(k, " ".join(["x"] * k + [w for run in runs for w in [*run, *["y"] * 7]])) for k in range(7)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    for most in (L.BROADCAST_ITEMS, 0):
        monkeypatch.setattr(L, "BROADCAST_ITEMS", most)
        assert sorted((r.doc_id, r.longest, r.tiles, r.coverage) for r in L.find_leaks(df, items).collect()) == [(k, 7, 4, 1.0) for k in range(7)]


def test_large_item_sets_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ITEMS", 0)
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert L.leaked(df, df.toDF("item_id", "text")).count() == 1


def test_reordered_parts_at_random_places(spark):
    """Items whose text stands whole in a document, as shuffled parts of seven words: all of them are found."""
    r = random.Random(11)
    docs, items = [], []
    for k in range(200):
        words = [f"i{k}w{j}" for j in range(42)]
        parts = [words[j : j + 7] for j in range(0, 42, 7)]
        r.shuffle(parts)
        text = [f"x{r.random()}" for _ in range(r.randrange(20))]
        for part in parts:
            text += part + [f"y{r.randrange(10**6)}" for _ in range(r.randrange(1, 9))]
        docs.append((k, " ".join(text)))
        items.append((k, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = L.find_leaks(df, bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in found) == [(k, k) for k in range(200)] and all(x.coverage == 1 for x in found)
    assert L.leaked(df, bench).count() == 0


def test_bounds_leave_out_only_what_no_tile_can_reach(spark):
    """Pairs and figures are those of tiling every pair."""
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: make(r.choice((7, 12, 20, 40))) for k in range(15)}
    docs = {k: make(r.choice((6, 30, 200))) for k in range(40)}
    for k in range(0, 40, 3):
        part = items[k % 15][2:16]
        docs[k] = make(9) + part + make(5) + part + make(9)
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], f"{name} bigint, text string")
    hashed = lambda words: np.array([hash(w) & (2**62 - 1) for w in words], dtype=np.uint64)
    for match, coverage in ((13, 0.5), (9, None), (13, 0.9)):
        expected = []
        for d, words in docs.items():
            for i, item in items.items():
                found = L.tiles(hashed(words), hashed(item))
                top, covered = max((t[2] for t in found), default=0), sum(t[2] for t in found)
                if top >= match or (coverage is not None and found and covered / len(item) >= coverage):
                    expected.append((d, i, top, len(found), covered))
        got = sorted((x.doc_id, x.item_id, x.longest, x.tiles, x.covered) for x in L.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), match, coverage).collect())
        assert got == sorted(expected) and expected
    with pytest.raises(ValueError):
        L.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), 5)
