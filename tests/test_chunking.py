"""Chunks against a plain model of the rules, on hand-written and generated markdown."""

import re

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.config import Chunking
from tessera.functions.text import is_noise
from tessera.operators.chunking import chunk_as, chunk_documents, overlap
from tessera.operators.markdown import parse
from pyspark.sql import functions as F

MAX, OVER = 30, 8


def tok(x):
    return len(x) // 4


def sents(x):
    return [s for s in (p.strip(" \t\r ") for p in re.findall(r"[^.!?\n]+[.!?]*", x)) if s]


def greedy(pieces, joiner, header=None, alone=False):
    base = tok(header) if header is not None else 0
    text = lambda cur: joiner.join(([header] if header is not None else []) + cur)
    out, cur, t = [], [], base
    for p in pieces:
        if alone and tok(p) > MAX:
            out += [(text(cur), t)] if cur else []
            out.append((p, tok(p)))
            cur, t = [], base
        elif t + tok(p) > MAX and cur:
            out.append((text(cur), t))
            cur, t = [p], base + tok(p)
        else:
            cur, t = cur + [p], t + tok(p)
    return out + ([(text(cur), t)] if cur else [])


def parts(kind, content):
    if tok(content) <= MAX:
        return [(content, tok(content))]
    if kind == "table":
        lines = content.strip(" \n\t\r").split("\n")
        return greedy(lines[2:], "\n", "\n".join(lines[:2])) if len(lines) >= 3 else [(content, tok(content))]
    if kind == "code_block":
        return greedy(content.split("\n"), "\n")
    if kind == "list":
        items = []
        for line in content.split("\n"):
            if re.match(r"\s*(?:[-*+] |\d+\.\s)", line):
                items.append(line)
            elif items:
                items[-1] += "\n" + line
        return greedy(items, "\n") if items else [(content, tok(content))]
    found = sents(content)
    return greedy(found, " ", alone=True) if found else [(content, tok(content))]


def model(text):
    """(content, tokens, type, path, split_sequence) of each chunk, in order of the document."""
    stack, buffer, out, path = [], [], [], None

    def flush():
        if buffer:
            whole = "\n\n".join(buffer)
            out.append((whole, tok(whole), "text", path, None))
            buffer.clear()

    for kind, content, level, language in parse(text):
        if kind == "heading":
            flush()
            stack = [h for h in stack if h[0] < level] + [(level, content)]
            path = " > ".join(h[1] for h in stack)
        elif stack:
            if tok(content) > MAX or kind in ("table", "code_block"):
                flush()
                name = {"table": "table", "list": "list", "code_block": f"code_{language or 'unknown'}"}.get(kind, "text")
                cut = parts(kind, content)
                out += [(c, t, name, path, f"{k}/{len(cut)}" if len(cut) > 1 else None) for k, (c, t) in enumerate(cut, 1)]
            else:
                if sum(map(tok, buffer)) + tok(content) > MAX:
                    flush()
                buffer.append(content)
    flush()
    return out


LINES = ["# One", "## Two words", "### Three", "# One", "plain words here", "A sentence. Another one! And a third? yes", "- item one\n- item two is longer\n  more of it", "1. first\n2. second",
         "| a | b |\n|---|---|\n| 1 | 2 |\n| 33333333333333333333 | 4444444444444444444444444444444 |\n| 555555555555555555555 | 66666666666666666666666666666666666666 |", "```py\nx = 1\n\ny = 2 + 3333333333333333333333333333333333333333333\nz = 4444444444444444444444444444444444444444444444444444\n```",
         "", "#tag", "***", "> quoted text", "long " * 40, "w" * 200 + ". Short one. " + "v" * 90, "- " + "i" * 100 + "\n- " + "j" * 100]


def chunks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = chunk_as("markdown", df, Chunking(MAX, 0)).orderBy("doc_id", "chunk_ord").collect()
    return [[(r.content, r.token_count, r.chunk_type, r.section_path, r.split_sequence) for r in found if r.doc_id == k] for k in range(len(texts))]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=14).map("\n".join), min_size=8, max_size=8))
def test_model(spark, texts):
    assert chunks(spark, texts) == [model(t) for t in texts]


def test_documents_without_headings_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "no heading", 0), (2, None, 0), (3, "", 0), (4, "# A\ntext of it", 1), (4, "# A\ntext of it", 1)], "doc_id bigint, text string, part int")
    assert rows(chunk_documents(df), "doc_id", "content", "section_path", "parent_section") == [(4, "text of it", "A", "A")]
    assert chunk_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunk_as("pdf", df)


def test_parent_and_links(spark):
    text = "# A > B\n" + "- " + "i" * 100 + "\n- " + "j" * 100
    df = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    first, second = chunk_as("markdown", df, Chunking(MAX, 0)).orderBy("chunk_ord").collect()
    assert first.parent_section == "B"
    assert (first.next_chunk_id, first.prev_chunk_id, second.prev_chunk_id, second.next_chunk_id) == (second.id, None, first.id, None)


def test_overlap(spark):
    schema = "doc_id bigint, section_path string, chunk_ord int, chunk_type string, content string, token_count int"
    data = [
        (1, "a", 1, "text", "First sentence here. Second sentence here.", 10),
        (1, "b", 2, "text", "Other section.", 3),
        (1, "a", 3, "text", "Third one.", 2),
        (1, "a", 4, "table", "| x |", 1),
        (1, "a", 5, "text", "No room " * 5, 12),
        (1, "a", 6, "text", "Last.", 1),
    ]
    found = overlap(spark.createDataFrame(data, schema), 5, 22).orderBy("emit_ord").collect()
    assert [r.chunk_ord for r in found] == [1, 3, 4, 5, 6, 2]
    got = {r.chunk_ord: r.content for r in found}
    assert got[1] == data[0][4] and got[4] == "| x |" and got[5] == data[4][4] and got[2] == "Other section."
    assert got[3] == "Second sentence here.\n\nThird one."
    assert got[6].endswith("\n\nLast.")


NOISE = {
    "short": ("References", False),
    "exactly 20": ("glossary" + "x" * 12, True),
    "marker": ("References\nSmith and others wrote", True),
    "marker without newline": ("references are good things to have", False),
    "three citations": ("the work (1999) and (2001) then (2003) it was good", False),
    "four citations": ("the work (1999) and (2001) then (2003) with (2004) it", True),
    "blank": (" " * 30, True),
    "titles": ("One Two Three Four Five Six Seven", True),
    "titles with a verb": ("One Two Three is Four Five Six Seven", False),
    "ratio 0.6": ("Aaaaa Bbbbb Ccccc ddddd eeeee", False),
    "null": (None, False),
}


def test_noise(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in NOISE.items()], "name string, text string")
    assert {r.name: r.noise for r in df.select("name", is_noise(F.col("text")).alias("noise")).collect()} == {k: v for k, (_, v) in NOISE.items()}
