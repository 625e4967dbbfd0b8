import random
import re

import numpy as np
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import neardup as N


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255), st.integers(0, 15)), min_size=1, max_size=30), st.integers(0, 6))
def test_trie_join(data, most):
    group = np.array([d[0] for d in data])
    bits = np.array([[d[1], d[2]] for d in data], dtype=np.uint8)
    a, b = N.trie_join(group, bits, most)
    expected = {(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if group[i] == group[j] and np.bitwise_count(bits[i] ^ bits[j]).sum() <= most}
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == expected and len(a) == len(expected)


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.choice((3, 12, 80)))]
        for _ in range(r.choice((1, 2, 5))):
            new = words[:]
            for _ in range(len(words) // 30):
                k = r.randrange(len(new))
                new[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
            texts.append(" ".join(new))
    return texts + ["", "one two", texts[0], texts[0].upper()]


def brute(texts, shingle, threshold):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", t.lower())
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)})
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b]]
    return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def frame(spark, texts):
    data = [("s", f"{k:04}", t, 5) for k, t in enumerate(texts)] + [("s", "null", None, 5), ("s", "0000", texts[0], 5), ("other", "0000", texts[0], 5)]
    return spark.createDataFrame(data, "src string, id string, content string, tid int")


def test_against_brute_force(spark):
    texts = corpus()
    for shingle, threshold in ((3, 0.6), (5, 0.8)):
        expected = sorted(("s", f"{a:04}", f"{b:04}") for a, b in brute(texts, shingle, threshold))
        assert expected and rows(N.similar_pairs(frame(spark, texts), shingle, threshold)) == expected


def test_hot_buckets_in_blocks(spark, monkeypatch):
    texts = corpus(2) + [f"same beginning of all texts here and more of it {k % 3}" for k in range(30)]
    whole = rows(N.similar_pairs(frame(spark, texts), 3, 0.6))
    assert whole == sorted(("s", f"{a:04}", f"{b:04}") for a, b in brute(texts, 3, 0.6))
    base, patched = frame(spark, texts), N._buckets

    def small(batches, most, forest):
        N.BLOCK = 4
        yield from patched(batches, most, forest)

    monkeypatch.setattr(N, "_buckets", small)
    assert rows(N.similar_pairs(base, 3, 0.6)) == whole


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 25), st.data())
def test_spanning(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] != e[1]), max_size=60, unique=True))
    a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
    tree, label = N.spanning(n, a, b)
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in edges:
        parent[root(x)] = root(y)
    assert all((label[x] == label[y]) == (root(x) == root(y)) for x in range(n) for y in range(n))
    assert len(tree) == n - len(set(map(root, range(n))))


def groups(texts, shingle=3, threshold=0.6):
    """id to (least id, members), by all pairs; copies of a text belong together."""
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    first = {}
    for a, b in [*brute(texts, shingle, threshold), *((first.setdefault(t, k), k) for k, t in enumerate(texts))]:
        parent[root(a)] = root(b)
    of = {}
    for k in range(len(texts)):
        of.setdefault(root(k), []).append(k)
    return {f"{k:04}": (f"{min(v):04}", len(v)) for v in of.values() for k in v}


def test_groups(spark):
    texts = corpus()
    found = {r.id: (r.group_id, r.members) for r in N.similar_groups(frame(spark, texts).filter("src = 's'"), 3, 0.6).collect()}
    assert found == groups(texts)


def variants(n):
    """Texts that change by one word from one to the next: a chain, in which distant ones aren't similar."""
    words = [f"w{k}" for k in range(40)]
    return [" ".join(words[: k % 40] + [f"v{k}x{j}" for j in range(1)] + words[k % 40 + 1 :]) for k in range(n)]


def test_groups_of_many_variants(spark, monkeypatch):
    texts = variants(300) + corpus(3)[:30]
    df = frame(spark, texts).filter("src = 's'")
    rows_ = df.filter("content is not null").selectExpr("xxhash64(src, content) as tid", "xxhash64(src) as salt", "content")
    for block in (N.BLOCK, 16):
        patched = N._buckets

        def small(batches, most, forest=False, size=block, run=patched):
            N.BLOCK = size
            yield from run(batches, most, forest)

        with monkeypatch.context() as m:
            m.setattr(N, "_buckets", small)
            assert {r.id: (r.group_id, r.members) for r in N.similar_groups(df, 3, 0.6).collect()} == groups(texts)
            few = N.group_links(rows_, 3, 0.6).count()
        assert few < 10 * len(texts) < len(brute(texts, 3, 0.6))


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    assert {r.group_id for r in N.components(edges).collect()} == {0} and N.components(edges).count() == 200
    assert N.components(edges.limit(0)).count() == 0


def test_empty(spark):
    empty = frame(spark, ["x"]).limit(0)
    assert N.similar_pairs(empty).count() == 0 and N.similar_groups(empty).count() == 0
