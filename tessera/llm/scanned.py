"""Problem 3: repair of text from scanned pages.

A vocabulary of the whole corpus is counted.  Each word has an anagram hash, the sum of its letters' hashes, so that a
confusion of characters changes it by a fixed difference: rare words are joined in SQL with frequent words on the hash
plus the difference of each confusion that they hold, or of two, and the most frequent variant is the correction.  The
confusions are those known of scanners and those that recur between rare and frequent words of the corpus's scans, but
not of its other texts.  Page numbers are lines that say so by their form, or plain numbers that stand in the sequence of
the document's numbers or beside a running head; the vocabulary is the evidence for and against a hyphen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import slices
from tessera.session import checkpointed

#: What scanners are known to read, and what stands on the page; the corpus adds its own (``learned``).
CONFUSIONS = [
    ("c", "e"), ("0", "o"), ("f", "t"), ("o", "a"), ("ri", "n"), ("!", "i"), ("l", "i"), ("1", "l"), ("1", "i"), ("5", "s"), ("cl", "d"),
    ("ii", "u"), ("b", "h"), ("(", "c"), ("rn", "m"), ("6", "b"), ("9", "g"), ("l", "1"), ("o", "0"), ("vv", "w"), ("m", "in"),
    ("h", "li"), ("m", "rn"), ("rm", "nn"), ("d", "cl"), ("ii", "ü"), ("6", "é"), ("2", "z"), ("z", "2"), ("s", "5"), ("b", "8"), ("a", "ä"), ("o", "ö"), ("u", "ü"),
]
#: How often the correction must occur for each time the rare word does; a short word needs more, one with a mark or digit in it less.
RATIO, SHORT_RATIO, MARKED_RATIO = 5, 20, 1
#: The same, and the letters of a word at least, for a word with two confusions.
DOUBLE_RATIO, DOUBLE_LETTERS = 20, 7
#: How often a rare word may occur and how often a frequent one must to be learned from; pairs of words that make a
#: confusion, and how much more frequent it must be in scans than elsewhere.
RARE, FREQUENT, PAIRS, CONTRAST = 2, 20, 5, 4
#: Scanned documents whose ids may be broadcast, at most.
BROADCAST_DOCUMENTS = 200_000
#: Times that a line must occur in a document to be a running head.
REPEATED = 3
#: Frequent words without a correction that are shipped to the tasks, so that their rows need no join; any number gives the same result.
SPARED = 20_000
#: How far apart numbers of one document's pages are, and the weight of signs that makes a document a scan: a cut word or a marked page has that weight, a plain number 1.
NEAR, SCAN = 60, 3

#: Kinds of chunk that hold no running text of pages.
NOT_PRINTED = ("code", "table", "list")

CUT = re.compile(r"[^\W\d_][-­‐¬]\s*$")
MARKS = "-­‐¬"
EDGE = ".,;:?\"'”“’‘»«)]}„…"
BEGIN = "\"“„«‘[¿¡'"
#: A cut word and its rest, which may stand after blank lines; neither counts for the vocabulary.
CUT_WORD = re.compile(r"\S+[-­‐¬][ \t\r]*\n\s*\S+")
PAGE = re.compile(
    r"\s*(?P<open>[\[(~–—-]?)\s*(?P<name>(?:pages?|pag|pág|página|seite|s|p|pp)\b\.?\s*)?(?:(?P<number>[\dlo]{1,4})|(?P<roman>c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})))"
    r"(?P<of>\s+(?:of|de|von|sur|/)\s+[\dlo]{1,4})?\s*(?P<close>[\])~–—-]?)\s*",
    re.IGNORECASE,
)
VOLUME = re.compile(r"\s*v[o0][l1i]\.?\s*[\dlo]+\s*,\s*n[o0r]\.?\s*[\dlo]+\s*", re.IGNORECASE)
NUMBER = re.compile(r"(?=.*\d)(?=.*[lo])[\dlo]+(?:[.,][\dlo]+)*$")
DIGITS = str.maketrans("lo", "10")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def word(token: str) -> str:
    """The form in which a token counts."""
    return token.lstrip(BEGIN).rstrip(EDGE).lower()


def fold(line: str) -> str:
    """Letters of a line without a page number at either end."""
    line = re.sub(r"^\s*[\dlo]{1,4}\s{2,}|\s{2,}[\dlo]{1,4}\s*$", "", line, flags=re.IGNORECASE)
    return re.sub(r"[\W_]+", "", line.lower())


def page(line: str) -> tuple[bool, int] | None:
    """Of a line that could be a page number: whether its form says so, and its number, those in Roman numerals from 10,000 on."""
    if VOLUME.fullmatch(line):
        return True, 0
    m = PAGE.fullmatch(line)
    if m is None or not (m["number"] or m["roman"]):
        return None
    sure = bool(m["name"] or m["of"] or (m["open"] and m["close"]))
    number, roman = m["number"], (m["roman"] or "").lower()
    if number and not any(c.isdigit() for c in number):  # letters that could be digits
        if not sure and (low := number.lower()) == "l":
            number, roman = None, low
        elif not sure:
            return None
    if number:
        return sure, int(number.lower().translate(DIGITS))
    values = [ROMAN[c] for c in roman]
    return sure, 10_000 + sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))


def furniture_lines(lines: list[str], heads: list[str], pages: set[int]) -> set[int]:
    """Indices of running heads and page numbers; ``pages`` are the numbers on lines of the whole document."""
    found, weak = set(), {}
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        if (p := page(line)) is not None:
            if p[0]:
                found.add(k)
            else:
                weak[k] = p[1]
        elif is_head(line, heads):
            found.add(k)
    if weak:
        body = [k for k, line in enumerate(lines) if line.strip()]
        beside = {x for a, b in zip(body, body[1:]) for x, y in ((a, b), (b, a)) if y in found}
        found |= {k for k, n in weak.items() if k in beside or any(n != m and abs(n - m) <= NEAR for m in pages)}
    return found


def is_head(line: str, heads: list[str]) -> bool:
    """Whether a line is one of the folded heads, perhaps cut short, but for a few characters."""
    this = fold(line)
    if len(this) < 6:
        return False
    for head in heads:
        if this == head or (len(this) >= 24 and head.startswith(this)):
            return True
        whole = len(head) if abs(len(head) - len(this)) <= 3 else len(this)
        if len(this) >= 10 and (abs(len(head) - len(this)) <= 3 or (len(this) >= 30 and len(head) > len(this))):
            if SequenceMatcher(None, this, head[:whole], autojunk=False).ratio() > 0.85:
                return True
    return False


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, value, n): words with their number, documents with the weight of their signs of scanning and, value by value, their page numbers."""
    words: Counter[str] = Counter()
    documents: Counter[str] = Counter()
    pages: set[tuple[str, int]] = set()

    def give() -> pa.RecordBatch:
        plain: Counter[str] = Counter()
        for token, n in words.items():
            if w := word(token):
                plain[w] += n
        found = [*((0, k, 0, n) for k, n in plain.items()), *((1, k, 0, n) for k, n in documents.items()), *((2, k, v, 1) for k, v in pages)]
        words.clear(), documents.clear(), pages.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int64()))], names=["kind", "key", "value", "n"])

    for batch in slices(batches, "content"):
        for document, text in zip(batch.column("document_id").to_pylist(), batch.column("content").to_pylist()):
            signs = 0
            if "\n" in text:
                cut = [m for m in MARKS if f"{m}\n" in text or f"{m} \n" in text or f"{m}\r" in text]
                if cut:
                    signs = SCAN * len(CUT_WORD.findall(text))
                    words.update(CUT_WORD.sub(" ", text).split())
                else:
                    words.update(text.split())
                for line in text.split("\n"):
                    if len(line) <= 40 and line.strip() and (p := page(line)) is not None:
                        signs += SCAN if p[0] else 1
                        if document is not None and not p[0]:
                            pages.add((document, p[1]))
            else:
                words.update(text.split())
            if signs and document is not None:
                documents[document] += signs
        if len(words) + len(pages) > 300_000:
            yield give()
    yield give()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded lines that could be running heads."""
    for batch in slices(batches, "content"):
        documents, lines = [], []
        for document, text in zip(batch.column("document_id").to_pylist(), batch.column("content").to_pylist()):
            for line in text.split("\n"):
                if 6 <= len(line) <= 90 and line.strip()[-1:] not in ".!?" and len(this := fold(line)) >= 6:
                    documents.append(document)
                    lines.append(this)
        yield pa.RecordBatch.from_arrays([pa.array(documents, pa.string()), pa.array(lines, pa.string())], names=["document_id", "head"])


def examine(text: str, heads: list[str], pages: set[int], known: set[int] | None = None) -> tuple[list[str], set[int], dict[int, tuple[int, str, str]]]:
    """Lines, indices of furniture, and for each line that ends in a cut word the index of the next body line, the part
    before the mark and the part after it.  ``known`` is furniture found before."""
    lines = text.split("\n")
    furniture = known if known is not None else furniture_lines(lines, heads, pages)
    body = [k for k, line in enumerate(lines) if k not in furniture and line.strip()]
    cuts = {}
    for k, following in zip(body, body[1:]):
        if CUT.search(lines[k]):
            first, rest = lines[k].split()[-1].rstrip(), lines[following].split()[0]
            rest = rest.rstrip(EDGE + "!")
            small = rest[:1].islower() or (first[:-1].isupper() and rest.isupper())
            if rest[:1].isalpha() and small:
                cuts[k] = (following, word(first[:-1]), word(rest))
    return lines, furniture, cuts


def _lines(batches: Iterator[pa.RecordBatch], spared: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, line_no, kind, word, other): one ``seen`` of each chunk, and those of furniture, cut words, and words that may be misread."""
    for batch in slices(batches, "content"):
        rows: list[tuple] = []
        for chunk, text, heads, pages in zip(*(batch.column(c).to_pylist() for c in ("id", "content", "heads", "pages"))):
            lines, furniture, cuts = examine(text, heads or [], set(pages or ()))
            rows.append((chunk, 0, "seen", None, None))
            rows += [(chunk, k + 1, "furniture", None, None) for k in furniture]
            rows += [(chunk, k + 1, "split", a, b) for k, (_, a, b) in cuts.items()]
            rest = {following for following, _, _ in cuts.values()}
            for k, line in enumerate(lines):
                if k in furniture:
                    continue
                tokens = line.split()[k in rest : -1 if k in cuts else None]
                for w in {word(t) for t in tokens}:
                    if NUMBER.match(w):  # has one reading only
                        rows.append((chunk, k + 1, "number", w, w.translate(DIGITS)))
                    elif w not in spared and len(w) > 1:
                        rows.append((chunk, k + 1, "word", w, None))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["chunk_id", "line_no", "kind", "word", "other"])


def anagram(text: Column) -> Column:
    """Sum of the hashes of a text's characters, whatever their order."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda a, c: a + F.xxhash64(c).bitwiseAND(F.lit((1 << 40) - 1)))


def holes(word: Column) -> Column:
    """Each way to take one or two successive characters out of a word: what is left, with a mark at the place, and what was taken."""
    def cut(size: int) -> Column:
        places = F.when(F.length(word) > size + 1, F.sequence(F.lit(1), F.length(word) - (size - 1))).otherwise(F.array().cast("array<int>"))
        rest = lambda p: F.concat(F.substring(word, F.lit(1), p - 1), F.lit("\x00"), F.substring(word, p + size, F.lit(99)))
        return F.transform(places, lambda p: F.struct(rest(p).alias("rest"), F.substring(word, p, F.lit(size)).alias("part")))

    return F.concat(cut(1), cut(2))


def learned(vocabulary: DataFrame) -> list[tuple[str, str]]:
    """Confusions (read, true) of ``vocabulary(word, n, scanned)`` beyond the known ones.

    A rare word that differs from a frequent one in a part of one or two characters makes a pair of parts.  Parts that
    pair far more often in words that only scans have than in words that no scan has are a confusion.  Every rare word of
    either kind counts.
    """
    plain = vocabulary.filter(F.length("word").between(4, 20) & F.col("word").rlike(r"^[\p{L}0-9!(]+$"))
    # all characters of a rare word may be misread, those of a frequent one are letters
    kinds = F.when(F.col("scanned") == F.col("n"), "scan").when(F.col("scanned") == 0, "other")
    rare = plain.filter(F.col("n") <= RARE).select("word", kinds.alias("kind")).filter("kind is not null")
    frequent = plain.filter((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}+$"))
    left = rare.select("kind", F.col("word").alias("rare"), F.inline(holes(F.col("word")))).withColumnRenamed("part", "read")
    right = frequent.select("word", "n", F.inline(holes(F.col("word")))).withColumnRenamed("part", "true")
    pairs = left.join(right, "rest").filter(F.substring("read", 1, 1) != F.substring("true", 1, 1)).filter(F.substring("read", -1, 1) != F.substring("true", -1, 1))
    best = pairs.groupBy("kind", "rare").agg(F.max(F.struct("n", "word", "read", "true")).alias("best"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = best.groupBy("best.read", "best.true").agg(n("scan").alias("scan"), n("other").alias("other"))
    sizes = {r["kind"]: r["count"] for r in rare.groupBy("kind").count().collect()}  # two rows
    share = sizes.get("scan", 0) / max(sizes.get("other", 0), 1)
    rows = counted.filter((F.col("scan") >= PAIRS) & (F.col("scan") >= CONTRAST * share * F.col("other"))).collect()
    return sorted({(r["read"], r["true"]) for r in rows} - set(CONFUSIONS))


def corrections(vocabulary: DataFrame, rare: DataFrame | None = None, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """``word``, ``correct`` of each of the words ``rare(word)``, or of all, with a confusable variant in ``vocabulary(word, n)`` that is frequent enough.

    The variant differs by one of ``CONFUSIONS`` and ``more``; if there is none, by two of them.  The most frequent wins.
    """
    pairs = F.array(*(F.struct(F.lit(read).alias("read"), F.lit(true).alias("true")) for read, true in [*CONFUSIONS, *(more or [])]))
    known = vocabulary.filter(F.length("word").between(2, 40)).select("word", "n").withColumn("hash", anagram(F.col("word")))
    asked = known if rare is None else known.join(rare.select("word"), "word", "left_semi")
    held = F.filter(pairs, lambda p: F.col("word").contains(p["read"]))  # at most as many rows a word as confusions
    held = F.transform(held, lambda p: F.struct(p["read"].alias("read"), p["true"].alias("true"), (anagram(p["true"]) - anagram(p["read"])).alias("step")))
    asked = checkpointed(asked.withColumn("held", held).filter(F.size("held") > 0))
    right = known.filter(~F.col("word").rlike(r"[!(]") & ~(F.col("word").rlike(r"\p{L}") & F.col("word").rlike("[0-9]")))
    variants = right.select(F.col("word").alias("correct"), F.col("n").alias("times"), "hash")
    places = F.sequence(F.lit(1), F.length("word"))

    def swapped(word: Column, p: Column, c: str) -> Column:
        """The word with the reading at ``p`` put right, or null if it isn't there."""
        right = F.concat(F.substring(word, F.lit(1), p - 1), F.col(f"{c}.true"), F.substring(word, p + F.length(f"{c}.read"), F.lit(99)))
        return F.when(F.substring(word, p, F.length(f"{c}.read")) == F.col(f"{c}.read"), right)

    marked = F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"[0-9!(]")
    ratio = F.when(marked, MARKED_RATIO).when(F.length("correct") <= 3, SHORT_RATIO).otherwise(RATIO)
    best = lambda df: df.groupBy("word").agg(F.max(F.struct("times", "correct")).alias("best")).select("word", "best.correct")
    one = asked.select("word", "n", "hash", F.explode("held").alias("a")).withColumn("hash", F.col("hash") + F.col("a.step"))
    one = one.join(variants, "hash").filter((F.col("times") >= ratio * F.col("n")) & F.exists(places, lambda p: F.coalesce(swapped(F.col("word"), p, "a") == F.col("correct"), F.lit(False))))
    one = checkpointed(best(one))
    two = asked.join(one, "word", "left_anti").filter(F.length("word") >= DOUBLE_LETTERS)
    two = two.select("word", "n", "hash", "held", F.posexplode("held").alias("at", "a"))
    two = two.select("word", "n", "hash", "a", F.explode(F.slice("held", F.col("at") + 1, F.size("held"))).alias("b"))
    two = two.withColumn("hash", F.col("hash") + F.col("a.step") + F.col("b.step"))
    frequent = variants.filter(F.col("times") >= DOUBLE_RATIO)
    first = lambda p: swapped(F.col("word"), p, "a")
    both = F.exists(places, lambda p: F.coalesce(F.exists(places, lambda q: F.coalesce(swapped(first(p), q, "b") == F.col("correct"), F.lit(False))), F.lit(False)))
    two = two.join(frequent, "hash").filter((F.col("times") >= DOUBLE_RATIO * F.col("n")) & both)
    return one.union(best(two))


def _examined(chunks: DataFrame) -> DataFrame:
    """The defects found: chunk_id, line_no, defect, word, correct; and ``seen`` for each chunk of a scanned document."""
    given = chunks.filter(F.col("content").isNotNull() & F.col("id").isNotNull()).select("id", "document_id", "section_path", "chunk_type", "content")
    rows = given.select("id", "document_id", "content").dropDuplicates(["id"])
    columns = "kind int, key string, value int, n bigint"
    counted = lambda df: df.select("document_id", "content").mapInArrow(_counts, columns).groupBy("kind", "key", "value").agg(F.sum("n").alias("n"))
    counts = checkpointed(counted(rows))
    scanned = counts.filter((F.col("kind") == 1) & (F.col("n") >= SCAN)).select(F.col("key").alias("document_id"))
    pages = counts.filter("kind = 2").groupBy(F.col("key").alias("document_id")).agg(F.collect_set("value").alias("pages"))  # numbers below 10,400

    printed = ~F.coalesce(F.lower("chunk_type"), F.lit("text")).isin(*NOT_PRINTED)
    few = scanned.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    scans = given.filter(printed).drop("chunk_type").join(F.broadcast(scanned) if few else scanned, "document_id", "left_semi").dropDuplicates(["id"])
    repeated = scans.select("document_id", "content").mapInArrow(_repeated, "document_id string, head string")
    repeated = repeated.groupBy("document_id", "head").count().filter(F.col("count") >= REPEATED).select("document_id", "head")
    title = F.lower(F.regexp_replace(F.split_part("section_path", F.lit(" > "), F.lit(1)), r"[^\p{L}\p{N}]+", ""))
    titles = scans.filter("section_path is not null").select("document_id", title.alias("head"))
    repeated = repeated.join(titles.select("document_id").distinct(), "document_id", "left_anti")  # where no title is known
    heads = repeated.union(titles).filter(F.length("head") >= 6).distinct().groupBy("document_id").agg(F.collect_list("head").alias("heads"))
    scans = scans.join(heads, "document_id", "left").join(pages, "document_id", "left")

    vocabulary = counts.filter("kind = 0").select(F.col("key").alias("word"), "n")
    of_scans = checkpointed(counted(scans).filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("scanned")))
    split_up = vocabulary.join(of_scans, "word", "left").withColumn("scanned", F.coalesce("scanned", F.lit(0)))
    correct = checkpointed(corrections(vocabulary, of_scans, learned(split_up)))
    spared = of_scans.join(correct, "word", "left_anti").orderBy(F.desc("scanned"), "word").limit(SPARED).toArrow()["word"].to_pylist()

    lines = scans.select("id", "content", "heads", "pages").mapInArrow(
        partial(_lines, spared=frozenset(spared)), "chunk_id string, line_no int, kind string, word string, other string"
    )
    lines = checkpointed(lines)
    cuts = lines.filter("kind = 'split'").withColumn("joined", F.concat("word", "other")).withColumn("compound", F.concat_ws("-", "word", "other"))
    times = lambda c: vocabulary.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n"))
    cuts = cuts.join(times("joined"), "joined", "left").join(times("compound"), "compound", "left")
    cuts = cuts.filter(F.coalesce("joined_n", F.lit(0)) >= F.coalesce("compound_n", F.lit(0)))
    words = lines.filter("kind = 'word'").join(correct, "word")
    none = F.lit(None).cast("string")
    found = (
        lines.filter("kind in ('furniture', 'seen')").select("chunk_id", "line_no", F.col("kind").alias("defect"), none.alias("word"), none.alias("correct"))
        .union(cuts.select("chunk_id", "line_no", F.lit("split"), "word", "joined"))
        .union(words.select("chunk_id", "line_no", F.lit("misread"), "word", "correct"))
        .union(lines.filter("kind = 'number'").select("chunk_id", "line_no", F.lit("misread"), "word", "other"))
    )
    return found


def defects(chunks: DataFrame) -> DataFrame:
    """``chunk_id``, ``line_no``, ``defect`` (split, misread or furniture) of lines of ``chunks(id, document_id, section_path, chunk_type, content)``.

    Lines of documents without any sign of scanning have none.  Null contents and null ids give no row; rows loaded
    twice count once; an empty table gives an empty result; further columns are ignored.
    """
    return _examined(chunks).filter("defect <> 'seen'").select("chunk_id", "line_no", "defect").distinct()


def repair(text: str, furniture: set[int], splits: set[int], correct: dict[str, str]) -> str:
    """Paragraphs of a text: without furniture, cut words joined, misread words corrected, lines of a paragraph in one.

    ``furniture`` and ``splits`` are numbers of lines, ``correct`` gives the words to put in place of misread ones.
    """
    lines, furniture, cuts = examine(text, [], set(), {n - 1 for n in furniture})
    out, joined = "", ""
    gap = True
    for k, line in enumerate(lines):
        if k in furniture:
            continue
        if not line.strip():
            gap = gap or not joined
            out += "" if joined or out.endswith("\n\n") or not out else "\n\n"
            continue

        def fixed(m: re.Match) -> str:
            right = correct.get(word(m[0]))
            if right is None:
                return m[0]
            bare = m[0].lstrip(BEGIN)
            before, bare = m[0][: len(m[0]) - len(bare)], bare.rstrip(EDGE)
            after = m[0][len(before) + len(bare) :]
            return before + (right.upper() if bare.isupper() and len(bare) > 1 else right.capitalize() if bare[:1].isupper() else right) + after

        line = re.sub(r"\S+", fixed, line.strip())
        out += line if joined or not out or out.endswith("\n\n") else f" {line}"
        joined = ""
        if k + 1 in splits:
            out, joined = out.rstrip()[:-1], "cut"
        elif k in cuts:
            joined = "compound"
    return out.strip()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "content"):
        texts = []
        for text, scanned, furniture, splits, pairs in zip(*(batch.column(c).to_pylist() for c in ("content", "scanned", "furniture", "splits", "pairs"))):
            if not scanned or text is None:
                texts.append(text)
            else:
                texts.append(repair(text, set(furniture or []), set(splits or []), {p["word"]: p["correct"] for p in pairs or []}))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["chunk_id", "content"])


def repaired(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` and repaired ``content`` of every chunk; those of documents that weren't scanned come out as they are."""
    lines = lambda kind: F.collect_set(F.when(F.col("defect") == kind, F.col("line_no")))
    words = F.collect_set(F.when(F.col("defect") == "misread", F.struct("word", "correct")))
    fixes = _examined(chunks).groupBy(F.col("chunk_id").alias("id")).agg(
        F.lit(True).alias("scanned"), lines("furniture").alias("furniture"), lines("split").alias("splits"), words.alias("pairs")
    )
    rows = chunks.filter("id is not null").select("id", "content").dropDuplicates(["id"])
    return rows.join(fixes, "id", "left").mapInArrow(_repair, "chunk_id string, content string")
