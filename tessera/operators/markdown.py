"""Markdown to typed elements: one small state machine a document, one row an element."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"(#{1,6})\s+(\S.*)$")
ITEM = re.compile(r"\s*(?:[-*+] |\d+\.\s)")
RULE = re.compile(r"[-*_]{3,}$")
KIND = pa.list_(pa.struct([("pos", pa.int32()), ("type", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("language", pa.string())]))


def starts(line: str, fenced: bool) -> str | None:
    """The type of element that a line begins, or None for a paragraph; ``drop`` for a line that belongs to none."""
    if HEADING.match(line):
        return "heading"
    if fenced:
        return "code_block"
    if "|" in line:
        return "table"
    if ITEM.match(line):
        return "list"
    if RULE.match(line.strip()):
        return "horizontal_rule"
    return "drop" if line.startswith(("#", "```")) else None


def parse(text: str | None) -> list[tuple[str, str, int | None, str | None]]:
    """(type, content, level, language) of each element.

    A line with a pipe is a table, also in prose; a line that begins with ``#`` but is no heading, and the opening line
    of a fence that is never closed, belong to no element.
    """
    lines, out, k = (text or "").split("\n"), [], 0

    def closing(at: int) -> int | None:
        return next((j for j in range(at + 1, len(lines)) if lines[j].strip().startswith("```")), None) if lines[at].startswith("```") else None

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        end = closing(k)
        kind = starts(line, end is not None)
        begin = k
        k += 1
        if kind == "heading":
            marks, title = HEADING.match(line).groups()
            out.append(("heading", title.strip(), len(marks), None))
        elif kind == "code_block":
            out.append(("code_block", "\n".join(lines[begin + 1 : end]), None, line[3:].strip() or None))
            k = end + 1
        elif kind == "table":
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                k += 1
            out.append(("table", "\n".join(lines[begin:k]), None, None))
        elif kind == "list":
            while k < len(lines) and lines[k].strip() and (ITEM.match(lines[k]) or lines[k].startswith("  ")):
                k += 1
            out.append(("list", "\n".join(lines[begin:k]), None, None))
        elif kind == "horizontal_rule":
            out.append(("horizontal_rule", line.strip(), None, None))
        elif kind is None:
            while k < len(lines) and lines[k].strip() and not lines[k].startswith("```") and starts(lines[k], False) is None:
                k += 1
            out.append(("paragraph", "\n".join(lines[begin:k]), None, None))
    return out


def _parse(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if once:
            seen: dict[tuple, int] = {}
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")))):
                seen.setdefault(row, k)
            batch = batch if len(seen) == batch.num_rows else batch.take(pa.array(list(seen.values()), pa.int64()))
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            rows = [[dict(zip(("pos", "type", "content", "level", "language"), (k, *e))) for k, e in enumerate(parse(t))] for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(rows, KIND)], names=["doc_id", "elements"])


def elements(documents: DataFrame, once: bool = False) -> DataFrame:
    """``doc_id, pos, type, content, level, language`` of each element of ``documents(doc_id, text, ...)``.

    Null, empty and blank texts have no elements; other columns are ignored.  A row loaded twice has its elements twice,
    or, with ``once``, once; then all elements of a document are in one partition.
    """
    schema = "doc_id bigint, elements array<struct<pos:int,type:string,content:string,level:int,language:string>>"
    parsed = documents.select("doc_id", "text").filter("text is not null").mapInArrow(partial(_parse, once=once), schema)
    rows = parsed.select("doc_id", F.inline("elements"))
    # copies are left out within a batch before they move, and among batches where they meet, without a further shuffle
    return rows.repartition("doc_id").dropDuplicates() if once else rows
