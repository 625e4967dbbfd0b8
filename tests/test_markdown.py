import pytest
from helpers import rows

from tessera.operators.markdown import elements, parse

CASES = {
    "heading": ("# A\ntext", [("heading", "A", 1, None), ("paragraph", "text", None, None)]),
    "no heading": ("#tag\n## \nx", [("paragraph", "x", None, None)]),
    "tag with a pipe": ("#tag | x", [("table", "#tag | x", None, None)]),
    "fence": ("```py\na\n\nb\n  ```\nx", [("code_block", "a\n\nb", None, "py"), ("paragraph", "x", None, None)]),
    "fence without language or body": ("```\n```", [("code_block", "", None, None)]),
    "open fence": ("```py\na", [("paragraph", "a", None, None)]),
    "prose with a pipe": ("a | b\nc", [("table", "a | b", None, None), ("paragraph", "c", None, None)]),
    "list with a pipe first": ("- a | b\n- c", [("table", "- a | b", None, None), ("list", "- c", None, None)]),
    "list with a pipe later": ("- a\n- b | c", [("list", "- a\n- b | c", None, None)]),
    "spaced rule is a list": ("- - -", [("list", "- - -", None, None)]),
    "rules": ("***\n*-_", [("horizontal_rule", "***", None, None), ("horizontal_rule", "*-_", None, None)]),
    "quote": ("> a\n> b", [("paragraph", "> a\n> b", None, None)]),
    "nested list": ("1. a\n  - b\n  c\nd", [("list", "1. a\n  - b\n  c", None, None), ("paragraph", "d", None, None)]),
    "list ends at a blank": ("- a\n\n- b", [("list", "- a", None, None), ("list", "- b", None, None)]),
    "nothing": (None, []),
    "blank": (" \n\t\n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_parse(name):
    text, expected = CASES[name]
    assert parse(text) == expected


def test_elements_of_rows(spark):
    df = spark.createDataFrame([(1, "# A\nb", 9), (2, None, 9), (3, "", 9), (4, "x\n" * 3, 9)], "doc_id bigint, text string, content int")
    assert rows(elements(df), "doc_id", "pos", "type") == [(1, 0, "heading"), (1, 1, "paragraph"), (4, 0, "paragraph")]
    assert elements(df.limit(0)).count() == 0
