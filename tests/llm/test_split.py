import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import split as S

WORDS = "x " * 900
CASES = {
    "paragraph": ("p " * 700 + "\n\n" + "q " * 700, "paragraph"),
    "paragraph with blanks": ("p " * 700 + "\r\n \t\r\n" + "q " * 700, "paragraph"),
    "line": ("p " * 700 + "\n" + "q " * 700 + "\n\n", "line"),
    "sentence": ("Some words of it. " * 130, "sentence"),
    "word": (WORDS * 2, "word"),
    "none": ("x" * 3000, "none"),
    "limit": ("y" * 2051, None),
    "over": ("y" * 2052, "none"),
}


@pytest.mark.parametrize("name", CASES)
def test_boundary(spark, name):
    text, expected = CASES[name]
    df = spark.createDataFrame([("c", text, 1)] * 2, "id string, content string, pieces int")
    assert [r.boundary for r in S.split_oversized(df).collect()] == ([expected] if expected else [])


def check(text, limit, overlap):
    _, cut = S.pieces(text, limit, overlap)
    bare = lambda x: re.sub(r"[ \t\r\n]+", "", x)
    assert bare("".join(text[a:b] for _, a, b in cut)) == bare(text)
    for (_, a0, b0), (o, a, b) in zip([(0, 0, 0), *cut], cut):
        assert S.tokens(b - o) <= limit and o <= a < b and a >= b0
        assert a - o <= overlap * S.CHARS and o >= a0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. ", "\n", "\n\n", "x" * 70, "Ä. ", "\r\n", "\t"]), min_size=1, max_size=80).map("".join), st.sampled_from([(20, 4), (12, 0), (40, 10)]))
def test_pieces(text, bounds):
    check(text, *bounds)


def test_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "short"), ("d", WORDS * 3)], "id string, content string")
    row = S.split_oversized(df).first()
    assert row.chunk_id == "d" and row.pieces[0].split_sequence == f"1/{len(row.pieces)}" and row.pieces[1].overlap > 0
    assert S.split_oversized(df.limit(0)).count() == 0
