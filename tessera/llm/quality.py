"""Problem 8: statistics of a text that tell running prose from lists, tables and junk, with fixed thresholds.

All statistics are counted for each line of a batch of texts at once, in numpy; the rules are plain column expressions
over a text's sums, and each rule that a text fails gives a reason.  Most rules are published ones, which tell bad pages
from good; whether a text is a list, a table or junk they don't say, so the last rules weigh the lines of each kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import Words, slices
from tessera.session import spread

#: Common words that may be shipped to the tasks, at most.
MOST_WORDS = 200_000
#: Marks that begin an entry of a list when a space follows.
BULLETS = "-*+•‣◦⁃–—·▪●☐☑☒✓✔"
#: Marks between the columns of a table.
BETWEEN = "|\t;,"
#: Marks that stand seldom in texts and never part columns.
ODD = "#$%^&*(){}[]~`@\\!?=+_"
ENDS = ".!?…:"
CLOSERS = "\"'”’»)]"

STATS = (
    "n_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, end_punctuation_ratio double, "
    "bullet_ratio double, short_line_ratio double, common_word_ratio double, distinct_line_ratio double, distinct_word_ratio double, long_word_ratio double, "
    "alphabetic_word_ratio double, hash_ratio double, ellipsis_ratio double, ellipsis_line_ratio double, common_words bigint, under_30_ratio double, duplicate_line_chars double, "
    "prose_share double, list_share double, table_share double, junk_share double"
)


def _mask(codes: np.ndarray, marks: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in marks], dtype=np.uint32))


class Lines:
    """Columns with a value for each line of the texts; ``doc`` is the index of its text."""

    def __init__(self, texts: list[str | None], languages: list[np.ndarray]):
        words = self.words = Words(texts)
        codes = words.codes
        n = len(codes)
        breaks = np.flatnonzero(codes == 10)
        self.start, self.end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [n]))
        self.doc = np.searchsorted(words.offset, self.start, side="right") - 1

        def count(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[self.end] - total[self.start]

        space = _mask(codes, " \t\r\n﻿   ​　")
        solid = np.flatnonzero(~space)
        first, last = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end) - 1
        self.blank = last < first
        at = lambda k: codes[solid[np.clip(k, 0, max(len(solid) - 1, 0))]] if len(solid) else np.zeros(len(k), np.uint32)
        begin = solid[np.clip(first, 0, max(len(solid) - 1, 0))] if len(solid) else np.zeros(len(first), np.int64)
        self.size = count(~space)
        alnum = np.zeros(n + 1, dtype=np.int64)
        np.add.at(alnum, words.start, 1)
        np.add.at(alnum, words.end, -1)
        letters = np.cumsum(alnum)[:n].astype(bool)
        digit = (codes >= 48) & (codes <= 57)
        self.spaces = count(space)
        self.symbols, self.digits = count(~letters & ~space), count(digit)
        self.between = np.stack([count(codes == ord(c)) for c in BETWEEN])
        gap = space & np.concatenate((space[1:], [False])) & (codes != 10)
        gap &= ~np.concatenate(([False], gap[:-1]))
        self.gaps = count(gap) - (begin - self.start > 1)
        self.tags = count(codes == ord("<"))
        self.odd = count(_mask(codes, ODD))
        following = np.concatenate((codes[1:], codes[:0] if not n else [0]))
        self.references = count((codes == ord("&")) & (following == ord("#")))
        self.broken = self.references + count(((codes == ord("\\")) & (following == ord("x"))) | (codes == 0xFFFD))
        dots = np.convolve(codes == ord("."), np.ones(3, dtype=np.int64))[2:] == 3 if n > 2 else np.zeros(n, dtype=bool)
        dots = np.concatenate((dots, np.zeros(max(n - len(dots), 0), dtype=bool)))[:n]
        self.hashes, self.ellipses = count(codes == ord("#")), count(codes == ord("…")) + count(dots & ~np.concatenate(([False], dots[:-1]))[:n])
        # words of each line
        line = np.searchsorted(self.start, words.start, side="right") - 1
        self.first_word = np.searchsorted(words.start, self.start)
        self.n_words = np.bincount(line, minlength=len(self.start))
        length = words.end - words.start
        self.letters = np.bincount(line, weights=length, minlength=len(self.start))
        self.long_words = np.bincount(line, weights=length > 20, minlength=len(self.start))
        digits = np.concatenate(([0], np.cumsum(digit)))
        self.numbers = np.bincount(line, weights=digits[words.end] - digits[words.start] == length, minlength=len(self.start))
        share = np.stack([np.bincount(line, weights=np.isin(words.hash, w), minlength=len(self.start)) for w in languages]) if languages else np.zeros((1, len(self.start)))
        docs = len(texts)
        by_doc = np.stack([np.bincount(self.doc, weights=s, minlength=docs) for s in share])
        self.common = share[by_doc.argmax(axis=0)[self.doc], np.arange(len(self.start))]
        # how a line begins and ends
        c1 = at(first)
        following = codes[np.minimum(begin + 1, n - 1)] if n else c1
        self.quote = c1 == ord(">")
        self.heading = (c1 == ord("#")) & _mask(following, "# ")
        bullet = _mask(c1, BULLETS) & _mask(following, " \t")
        # "12." or "a)" or "(3)" and a space
        one = np.clip(self.first_word, 0, max(len(words.start) - 1, 0))
        if len(words.start):
            near = words.start[one] - begin <= 1
            mark = words.end[one]
            after = codes[np.minimum(mark, n - 1)]
            then = codes[np.minimum(mark + 1, n - 1)]
            short = length[one] <= 3
            numeral = digit[words.start[one]] | (length[one] == 1) | np.isin(words.hash[one], _ROMAN())
            bullet |= (self.n_words > 0) & near & short & numeral & _mask(after, ".):/") & _mask(then, " \t")
        self.bullet = bullet & ~self.blank
        e1 = at(last)
        closed = _mask(e1, CLOSERS) & (last > first)
        self.ended = _mask(np.where(closed, at(last - 1), e1), ENDS) & ~self.blank
        self.trailing = ((e1 == ord("…")) | ((e1 == ord(".")) & (at(last - 1) == ord(".")) & (at(last - 2) == ord(".")) & (last - 2 >= first))) & ~self.blank
        stop = _mask(codes, ".!?") & np.concatenate((space[1:] | _mask(codes[1:], CLOSERS), [True]))
        self.stops = count(stop)
        total = np.concatenate(([np.uint64(0)], np.cumsum(words.hash, dtype=np.uint64)))
        self.print = total[self.first_word + self.n_words] - total[self.first_word] + self.symbols.astype(np.uint64)


def _ROMAN() -> np.ndarray:
    return Words(["ii", "iii", "iv", "vi", "vii", "ix", "xi", "xii", "xiv", "xv", "xx"]).hash


def line_kinds(x: Lines) -> np.ndarray:
    """For each line 0 (neutral: blank or a heading), 1 prose, 2 list, 3 table, 4 junk."""
    words = np.maximum(x.n_words, 1)
    size = np.maximum(x.size, 1)
    share = x.common / words
    columns = x.between.max(axis=0)
    kind = np.ones(len(x.start), dtype=np.int64)

    # runs of lines without the end of a sentence: broken prose has one every few lines, a list has none
    new = np.concatenate(([True], x.doc[1:] != x.doc[:-1]))
    text = ~x.blank & ~x.heading
    run = np.cumsum(new | (text & (x.stops > 0)))
    quiet = text & (x.stops == 0)
    total = lambda v, by: np.bincount(by, weights=v)[by]
    lines = total(quiet, run)
    short = total(np.where(quiet, x.n_words, 0), run) / np.maximum(lines, 1) < 10
    entry = quiet & (x.n_words <= 14) & short & ((lines >= 4) | (total(text, x.doc) == lines)) & (total(x.n_words > 14, x.doc) < lines)
    kind[entry] = 2
    # entries that end as sentences do, one a line: short ones in a row, where prose has longer sentences or several a line
    whole = text & (x.stops == 1) & x.ended & (x.n_words <= 12)
    block = np.cumsum(new | (text & ~whole))
    kind[whole & (total(whole, block) >= 4)] = 2
    kind[x.bullet] = 2

    odd = x.symbols + x.digits
    piped = (x.between[0] >= 2) & (x.size > 0)
    tabbed = x.between[1] >= 1
    parted = (x.between[2] - x.references >= 2) & (share < 0.15)
    comma = (x.between[3] >= 2) & (share < 0.15) & ~x.ended
    spaced = (x.gaps >= 2) & (share < 0.25) & ~x.ended
    table = piped | (tabbed & (share < 0.25)) | parted | comma | spaced | (x.tags >= 4)
    table &= ~((x.n_words >= 12) & (share >= 0.2))  # prose with stray marks
    broken = (x.broken >= 3) & (x.broken > 0.3 * (x.spaces + 1))
    table &= ~broken
    kind[table] = 3
    # the few rows of a table whose columns don't show
    block = np.cumsum(new | x.blank)
    kind[entry & ~x.bullet & (total(table, block) > 0.12 * total(text, block))] = 3

    mean = x.letters / words
    bad = broken | ((odd > 0.45 * size) & ~table & ~x.bullet)
    bad |= (mean > 14) & (x.size > 25)
    bad |= x.odd > 0.3 * size
    bad |= (x.size >= 25) & (x.spaces == 0) & ~table  # nothing that parts words
    bad |= (x.n_words >= 9) & (share < 0.08) & ~table & ~x.bullet
    kind[bad] = 4
    kind[x.heading] = 0
    kind[x.blank] = 0
    return kind


def _statistics(batches: Iterator[pa.RecordBatch], languages: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        docs = len(texts)
        x = Lines(texts, languages)
        kind = line_kinds(x)
        total = lambda v: np.bincount(x.doc, weights=v, minlength=docs)
        full = ~x.blank
        size, lines, words = np.maximum(total(x.size), 1), np.maximum(total(full), 1), total(x.n_words)
        some = np.maximum(words, 1)

        def distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
            order = np.lexsort((value, doc))
            d, v = doc[order], value[order]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])))[: len(d)]
            return np.bincount(d[new], minlength=docs)

        w = x.words
        different = distinct(w.doc, w.hash)
        order = np.lexsort((np.arange(len(x.doc)), x.print, x.doc))
        again = np.zeros(len(x.doc), dtype=bool)
        again[order[1:]] = (x.doc[order[1:]] == x.doc[order[:-1]]) & (x.print[order[1:]] == x.print[order[:-1]])
        again &= full
        sized = np.maximum(total(np.where(kind > 0, x.size, 0)), 1)
        columns = [
            w.size.astype(np.int64), total(full).astype(np.int64), words.astype(np.int64),
            np.where(words > 0, total(x.letters) / some, 0), total(x.symbols) / size, total(x.digits) / size, total(x.ended) / lines,
            total(x.bullet) / lines, total(full & (x.n_words < 6)) / lines, total(x.common) / some,
            distinct(x.doc[full], x.print[full]) / lines, different / some, total(x.long_words) / some,
            1 - total(x.numbers) / some, total(x.hashes) / some, total(x.ellipses) / some, total(x.trailing) / lines, total(x.common).astype(np.int64),
            total(full & (x.size + x.spaces < 30)) / lines, total(np.where(again, x.size, 0)) / size,
            *(total(np.where(kind == k, x.size, 0)) / sized for k in (1, 2, 3, 4)),
        ]
        names = [c.split()[0] for c in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *names])


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each row of ``documents(doc_id, text, ...)``.

    Common words are those of the language of which the text has most.  Null, empty and blank texts have zero words and
    shares of 0; rows loaded twice come out twice; further columns are ignored.  The common words are shipped to the tasks
    (an error is raised if there are more than ``MOST_WORDS``).
    """
    rows = common_words.select("lang", "word").filter("word is not null").distinct().limit(MOST_WORDS + 1).toArrow().to_pylist()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    by: dict[str, list[str]] = {}
    for row in rows:
        by.setdefault(row["lang"], []).append(row["word"])
    languages = [np.unique(Words([" ".join(by[k])]).hash) for k in sorted(by, key=str)]
    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(partial(_statistics, languages=languages), f"doc_id bigint, {STATS}")


#: Published rules by name: the condition under which a text fails. Fixed values: "g" those for quality and repetition of
#: Rae et al. 2021 (Scaling Language Models, appendix A.1.1), "f" those of Penedo et al. 2024 (FineWeb, section 3.6).
#: Two of its eight stop words become two common words of the text's own language.
PUBLISHED = {
    "g_few_words": "n_words < 50",
    "g_many_words": "n_words > 100000",
    "g_word_length": "mean_word_length < 3 OR mean_word_length > 10",
    "g_hashes": "hash_ratio > 0.1",
    "g_ellipses": "ellipsis_ratio > 0.1",
    "g_bullets": "bullet_ratio > 0.9",
    "g_ellipsis_lines": "ellipsis_line_ratio > 0.3",
    "g_alphabetic_words": "alphabetic_word_ratio < 0.8",
    "g_stop_words": "common_words < 2",
    "g_duplicate_lines": "n_lines > 1 AND 1 - distinct_line_ratio > 0.3",
    "g_duplicate_line_chars": "duplicate_line_chars > 0.2",
    "f_line_ends": "end_punctuation_ratio <= 0.12",
    "f_duplicate_line_chars": "duplicate_line_chars >= 0.1",
    "f_short_lines": "under_30_ratio >= 0.67",
}
#: Own rules, of which each names a kind; the first that holds decides. Less than half of a text in sentences is the
#: problem's own bound; the others follow from it, and from that a text of one phrase over and over has no sentences.
OWN = {
    "repeated_lines": "n_lines >= 5 AND distinct_line_ratio < 0.35",
    "repeated_words": "n_words >= 40 AND distinct_word_ratio < 0.12",
    "mostly_junk": "prose_share < 0.5 AND junk_share > 0 AND junk_share >= greatest(list_share, table_share)",
    "mostly_table": "prose_share < 0.5 AND table_share > junk_share AND table_share >= list_share",
    "mostly_list": "prose_share < 0.5 AND list_share > greatest(junk_share, table_share)",
}
KINDS = {"repeated_lines": "junk", "repeated_words": "junk", "mostly_junk": "junk", "mostly_table": "table", "mostly_list": "list"}
RULES = PUBLISHED | OWN


def quality_report(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics with ``reasons`` (rules failed, in order of ``RULES``) and ``kind``: what the first own rule failed names, else prose or, without words or marks, blank."""
    stats = text_statistics(documents, common_words)
    reasons = F.filter(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items())), lambda x: x.isNotNull())
    kind = F.when(F.col("n_lines") == 0, "blank")
    for name in OWN:
        kind = kind.when(F.array_contains("reasons", name), KINDS[name])
    return stats.withColumn("reasons", reasons).withColumn("kind", kind.otherwise("prose"))


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind`` (list, table or junk) of texts of which less than half is running prose."""
    return quality_report(documents, common_words).filter(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")
