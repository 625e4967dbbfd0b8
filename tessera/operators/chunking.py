"""Elements to chunks: sections, noise, packing under a budget of tokens, links and overlap, as windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import Chunking
from tessera.functions.text import is_noise, sentences, stable_id, token_count
from tessera.operators.markdown import elements

ITEM_START = r"\n(?=\s*(?:[-*+] |\d+\.\s))"
PARTS = "array<struct<content:string,tokens:int>>"


def sections(rows: DataFrame) -> DataFrame:
    """Content elements with ``section_ord``, ``section_path`` and ``parent_section``; those before the first heading fall away.

    A heading of level n ends all open headings of level n and more, so that of each level the last heading is open if
    no later one has a lower level.
    """
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    heading = F.col("type") == "heading"
    out = rows.withColumn("section_ord", F.sum(heading.cast("int")).over(so_far).cast("int"))
    above, path = F.lit(-1), []
    for level in range(1, 7):
        here = F.max(F.when(heading & (F.col("level") == level), F.struct("pos", "content"))).over(so_far)
        open_ = here["pos"] > above
        path.append(F.when(open_, here["content"]))
        above = F.greatest(above, F.coalesce(here["pos"], F.lit(-1)))
    out = out.withColumn("section_path", F.array_join(F.array_compact(F.array(*path)), " > "))
    out = out.filter(~heading & (F.col("section_ord") > 0))
    return out.withColumn("parent_section", F.element_at(F.split("section_path", " > "), -1))


def greedy(pieces: Column, joiner: str, most: int, header: Column | None = None, alone: bool = False) -> Column:
    """Pieces packed in order into parts of at most ``most`` tokens, each a struct of content and the sum of its pieces' tokens.

    A header stands before each part and counts in it.  A piece over the limit makes a part of its own; with ``alone``
    the part before it is closed and the next one begins anew.
    """
    base = token_count(header) if header is not None else F.lit(0)
    text = lambda cur: F.array_join(F.concat(F.array(header), cur) if header is not None else cur, joiner)
    state = "struct<done:array<struct<content:string,tokens:int>>,cur:array<string>,t:int>"
    start = F.struct(F.array().cast(PARTS).alias("done"), F.array().cast("array<string>").alias("cur"), base.cast("int").alias("t")).cast(state)
    part = lambda s: F.array(F.struct(text(s["cur"]).alias("content"), s["t"].alias("tokens"))).cast(PARTS)
    closed = lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], part(s))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        t = token_count(p)
        fresh = F.struct(closed(s).alias("done"), F.array(p).alias("cur"), (base + t).cast("int").alias("t")).cast(state)
        more = F.struct(s["done"].alias("done"), F.concat(s["cur"], F.array(p)).alias("cur"), (s["t"] + t).cast("int").alias("t")).cast(state)
        out = F.when((s["t"] + t > most) & (F.size(s["cur"]) > 0), fresh).otherwise(more)
        if alone:
            single = F.array(F.struct(p.alias("content"), t.alias("tokens"))).cast(PARTS)
            empty = F.struct(F.concat(closed(s), single).alias("done"), F.array().cast("array<string>").alias("cur"), base.cast("int").alias("t")).cast(state)
            out = F.when(t > most, empty).otherwise(out)
        return out

    return F.aggregate(pieces, start, step, closed)


def whole(content: Column) -> Column:
    return F.array(F.struct(content.alias("content"), token_count(content).alias("tokens"))).cast(PARTS)


def split_text(content: Column, most: int) -> Column:
    """Parts of a text of whole sentences."""
    found = sentences(content)
    return F.when((token_count(content) <= most) | (F.size(found) == 0), whole(content)).otherwise(greedy(found, " ", most, alone=True))


def split_table(content: Column, most: int) -> Column:
    """Parts of a table of whole rows, each with the first two lines."""
    lines = F.split(F.trim(content, F.lit(" \n\t\r")), "\n")
    header = F.array_join(F.slice(lines, 1, 2), "\n")
    rows = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return F.when((token_count(content) <= most) | (F.size(lines) < 3), whole(content)).otherwise(greedy(rows, "\n", most, header))


def split_code(content: Column, most: int) -> Column:
    return F.when(token_count(content) <= most, whole(content)).otherwise(greedy(F.split(content, "\n"), "\n", most))


def split_list(content: Column, most: int) -> Column:
    """Parts of a list of whole items; lines before the first item fall away."""
    items = F.filter(F.split(content, ITEM_START), lambda x: x.rlike(r"^\s*(?:[-*+] |\d+\.\s)"))
    return F.when((token_count(content) <= most) | (F.size(items) == 0), whole(content)).otherwise(greedy(items, "\n", most))


def pack(rows: DataFrame, most: int) -> DataFrame:
    """Chunks of sectioned elements: small elements of a section together, tables, code and oversized ones by their splitters.

    Columns: doc_id, section_ord, pos (of the first element), part, parts, content, token_count, chunk_type,
    section_path, parent_section.
    """
    rows = rows.filter(~is_noise(F.col("content"))).withColumn("tokens", token_count(F.col("content")))
    rows = rows.withColumn("special", (F.col("tokens") > most) | F.col("type").isin("code_block", "table"))
    # the buffer that each element falls into, by a fold over its section; a special element has one for itself
    kind = "struct<out:array<int>,buffer:int,t:int>"

    def step(s: Column, e: Column) -> Column:
        fits = s["t"] + e["tokens"] <= most
        at = F.when(e["special"] | ~fits, s["buffer"] + 1).otherwise(s["buffer"])
        t = F.when(e["special"], F.lit(0)).when(fits, s["t"] + e["tokens"]).otherwise(e["tokens"])
        after = F.when(e["special"], at + 1).otherwise(at)
        return F.struct(F.concat(s["out"], F.array(at)).alias("out"), after.alias("buffer"), t.alias("t")).cast(kind)

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("buffer"), F.lit(0).alias("t")).cast(kind)
    keys = ["doc_id", "section_ord"]
    columns = ["pos", "special", "tokens", "type", "content", "language"]
    grouped = rows.groupBy(*keys).agg(
        F.first("section_path").alias("section_path"), F.first("parent_section").alias("parent_section"), F.array_sort(F.collect_list(F.struct(*columns))).alias("items")
    )
    buffers = F.aggregate("items", start, step, lambda s: s["out"])
    placed = F.zip_with("items", buffers, lambda e, at: F.struct(*(e[c].alias(c) for c in columns), at.alias("buffer")))
    placed = grouped.select(*keys, "section_path", "parent_section", F.inline(placed))

    inner = F.array_sort(F.collect_list(F.struct("pos", "content")))
    chunks = placed.groupBy(*keys, "buffer").agg(
        F.min("pos").alias("pos"), F.first("section_path").alias("section_path"), F.first("parent_section").alias("parent_section"),
        F.first("special").alias("special"), F.first("type").alias("type"), F.first("language").alias("language"),
        F.array_join(F.transform(inner, lambda x: x["content"]), "\n\n").alias("content"),
    )
    content, type_, special = F.col("content"), F.col("type"), F.col("special")
    cut = F.when(~special, whole(content)).when(type_ == "table", split_table(content, most)).when(type_ == "code_block", split_code(content, most))
    cut = cut.when(type_ == "list", split_list(content, most)).otherwise(split_text(content, most))
    name = F.when(~special, "text").when(type_ == "table", "table")
    name = name.when(type_ == "code_block", F.concat(F.lit("code_"), F.coalesce("language", F.lit("unknown")))).when(type_ == "list", "list").otherwise("text")
    cuts = chunks.select(*keys, "pos", name.alias("chunk_type"), "section_path", "parent_section", cut.alias("cut"))
    cuts = cuts.select(*keys, "pos", "chunk_type", "section_path", "parent_section", F.size("cut").alias("parts"), F.posexplode("cut").alias("part", "c"))
    return cuts.select(
        *keys, "pos", (F.col("part") + 1).alias("part"), "parts", F.col("c.content").alias("content"), F.col("c.tokens").alias("token_count"),
        "chunk_type", "section_path", "parent_section",
    )


def link(packed: DataFrame) -> DataFrame:
    """Packed chunks with stable ids, their order in the document, and links between the parts of one element."""
    order = Window.partitionBy("doc_id").orderBy("section_ord", "pos", "part")
    rows = packed.withColumn("chunk_ord", F.row_number().over(order).cast("int"))
    several = F.col("parts") > 1
    at = lambda k: stable_id(F.col("doc_id"), F.col("chunk_ord") + k)
    return rows.select(
        at(0).alias("id"), "doc_id", "chunk_ord", "content", "token_count", "chunk_type", "parent_section", "section_path",
        F.when(several, F.concat_ws("/", "part", "parts")).alias("split_sequence"),
        F.when(several & (F.col("part") < F.col("parts")), at(1)).alias("next_chunk_id"),
        F.when(several & (F.col("part") > 1), at(-1)).alias("prev_chunk_id"),
    )


def tail(content: Column, target: Column) -> Column:
    """The last sentences of a text, about ``target`` tokens of them, joined by spaces; null if there are none."""
    kind = "struct<took:array<string>,t:int,stop:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("took"), F.lit(0).alias("t"), F.lit(False).alias("stop")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        t = token_count(x)
        over = (s["t"] > 0) & (s["t"] + t > target * 1.5)
        stopped = F.struct(s["took"].alias("took"), s["t"].alias("t"), F.lit(True).alias("stop")).cast(kind)
        took = F.struct(F.concat(F.array(x), s["took"]).alias("took"), (s["t"] + t).alias("t"), (s["t"] + t >= target).alias("stop")).cast(kind)
        return F.when(s["stop"], s).when(over, stopped).otherwise(took)

    took = F.aggregate(F.reverse(sentences(content)), start, step, lambda s: s["took"])
    return F.when(F.size(took) > 0, F.array_join(took, " "))


def overlap(chunks: DataFrame, overlap_tokens: int = 50, most: int = 512) -> DataFrame:
    """Chunks that begin with the end of the chunk before in their section; ids and links stay.

    Tables, the first chunk of a section, and chunks without room stay as they are.  ``emit_ord`` is the order in which
    sections of the same path stand together.
    """
    group = Window.partitionBy("doc_id", "section_path").orderBy("chunk_ord")
    before = F.lag("content").over(group)
    first = F.min("chunk_ord").over(Window.partitionBy("doc_id", "section_path"))
    rows = chunks.withColumn("before", before).withColumn("group_ord", first)
    safe = F.least(F.lit(overlap_tokens), F.lit(most - 10) - F.col("token_count"))
    able = F.col("before").isNotNull() & (F.col("chunk_type") != "table") & (safe > 0)
    rows = rows.withColumn("suffix", F.when(able, tail(F.col("before"), safe)))
    longer = F.concat("suffix", F.lit("\n\n"), "content")
    fits = F.col("suffix").isNotNull() & (token_count(longer) <= most)
    rows = rows.withColumn("longer", F.when(fits, longer))
    rows = rows.withColumn("token_count", F.when(F.col("longer").isNotNull(), token_count(F.col("longer"))).otherwise(F.col("token_count")))
    rows = rows.withColumn("content", F.coalesce("longer", "content"))
    emit = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_ord", "chunk_ord"))
    return rows.withColumn("emit_ord", emit.cast("int")).drop("before", "group_ord", "suffix", "longer")


def chunk_documents(documents: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """All chunks of ``documents(doc_id, text, ...)``.

    Documents without headings have none; null and blank texts neither.  Rows loaded twice count once, a doc_id is taken
    to have one text; further columns are ignored.  All steps share one partitioning by ``doc_id``.
    """
    linked = link(pack(sections(elements(documents, once=True)), config.max_tokens))
    return overlap(linked, config.overlap_tokens, config.max_tokens)


def chunk_as(kind: str, documents: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Chunks of documents of a registered kind; others are an error."""
    if kind not in CHUNKERS:
        raise ValueError(f"unknown kind of document: {kind}; known are {sorted(CHUNKERS)}")
    return CHUNKERS[kind](documents, config)


CHUNKERS = {"markdown": chunk_documents}
