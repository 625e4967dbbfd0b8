"""HTML to markdown: headings, paragraphs, lists, links, tables, code and image marks, from the standard parser's events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content of the page, and elements that part blocks.
HIDDEN = {"script", "style", "nav", "footer", "head", "noscript", "template"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "main", "header", "figure", "form", "aside"}
IMAGE = "<!-- image -->"


class _Renderer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = [""]
        self.hidden, self.lists, self.href, self.pre, self.rows = 0, [], [], False, 0

    def block(self, gap: str = "\n\n") -> None:
        if self.out[-1].strip() or not self.out[-1].endswith("\n"):
            self.out.append(gap)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.block("\n" if self.lists else "\n\n")
            self.lists.append(0 if tag == "ol" else -1)
        elif tag == "li":
            self.block("\n")
            kind = self.lists[-1] if self.lists else -1
            if kind >= 0:
                self.lists[-1] = kind = kind + 1
            self.out.append("  " * (len(self.lists) - 1) + (f"{kind}. " if kind > 0 else "- "))
        elif tag == "tr":
            self.block("\n")
            self.out.append("|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre = True
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            self.block()
            self.out.append(IMAGE)
            self.block()
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in BLOCKS:
            self.block()
            self.rows = 0

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self.block("\n" if self.lists else "\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr":
            self.rows += 1
            if self.rows == 1:
                row = "".join(self.out).rsplit("\n", 1)[-1]
                self.out.append("\n|" + " --- |" * max(1, row.count("|") - 1))
        elif tag == "pre":
            self.out.append("\n```")
            self.pre = False
            self.block()
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in BLOCKS or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def render(html: str) -> str:
    """Markdown of a page."""
    parser = _Renderer()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?=[^\s\-\d])", "\n", text)).strip()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, errors = [], []
        for html in batch.column("html").to_pylist():
            try:
                done.append(render(html) if html else "")
                errors.append(None if html else "empty")
            except Exception as error:  # a page that can't be read must not end the job
                done.append("")
                errors.append(type(error).__name__)
        rest = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(done, pa.string()), pa.array(errors, pa.string())], names=[*rest, "markdown", "error"])


def html_to_markdown(pages: DataFrame, key: str, html: str, *others: str) -> DataFrame:
    """``key`` (as a string), the ``others`` (strings) as they are, ``markdown`` and ``error`` of each page; an empty or unreadable one has empty markdown and an error."""
    rows = pages.select(F.col(key).cast("string").alias("key"), *others, F.col(html).alias("html"))
    schema = ", ".join(f"`{c}` string" for c in ("key", *others, "markdown", "error"))
    return rows.mapInArrow(_render, schema).withColumnRenamed("key", key)
