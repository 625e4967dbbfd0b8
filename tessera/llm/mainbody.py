"""Problem 1: the main body of web pages, by a maximum-scoring subsequence of their lines.

Words and tags (how a line begins and ends, its length, links, separators) have weights from labelled lines; a line's
score is the sum of its weights, and one linear scan finds the contiguous region of greatest score.  What else is known
of a line is a tag in its score too: that it is the page's title, stands before it, is known furniture, or lists other
pages.  Within the region lines of negative score are furniture that stands between paragraphs.

Nobody labels the pages by hand: in a bounded sample of pages, a line that several sites share is furniture, a whole
sentence that stands on one page only is article.  Lines known as furniture, and lines after which other pages' titles
follow, are counted over all pages by hashes of lines, and found again or joined back by them.  Words, tags, scores
and regions of a batch of pages are numpy columns.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import U, Words, list_array, mix, slices
from tessera.session import checkpointed, spread

#: Pages that the weights are fitted on, about.
SAMPLE_PAGES = 4_000
#: Sites that share a line of furniture; times that a line must be seen to be judged as an opener, and the share of titles after it.
SITES, SEEN, OPENS = 3, 4, 0.6
#: Sites that make a line known furniture wherever it stands, or fewer sites and so many pages.
KNOWN_SITES, FEW_SITES, MANY_PAGES = 5, 2, 8
#: Known lines and openers whose hashes may be broadcast (16 MB), at most; more are joined to the pages that have them.
BROADCAST_LINES = 2_000_000
#: Bits of a line's form: a whole sentence, what could be a title.
SENTENCE, TITLE = 1, 2
#: Score from which a sentence outside the region is article.
KEEP = 3.0
#: A weight at most; the weight from which a token of a sentence counts for the article; the scores below which a
#: sentence, or another line, within the region is furniture; a line's score at most, which is also, negative, that of the
#: tag of lines before the title; that of the title's tag.
CLIP, LEVEL, CUT_SENTENCE, CUT, BOUND, HEAD = 3.0, 0.9, 0.0, -2.0, 8.0, 24.0
#: Lines that hold something besides white space, below which a content is a snippet and no page.
PAGE_LINES = 3

CLOSING = "\"'”’»)"
STOPS = ".!?"
#: Marks that count as words, those that part words when white space is around them, and those that begin an entry.
SIGNS, PARTING, BULLETS = "©®›»·|→…@", "|·›»>/•–—-", "-*+•‣▪–"
#: Words of a line from which each of its tags of length begins.
LENGTHS = np.array([1, 2, 3, 4, 5, 8, 12, 20])
TAGS = 40
NUMBER, SITE = U(0x5EED0), U(0x5EED1)


@cache
def _spaces() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), dtype=bool, count=0x110000)


def _of(codes: np.ndarray, marks: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in marks], dtype=np.uint32))


def site_name(host: str | None, url: str | None) -> str:
    host = host or re.sub(r"^[a-z]+://([^/:?#]*).*", r"\1", (url or "").lower(), flags=re.DOTALL)
    return re.sub(r"[^a-z]+", " ", host.lower()).strip()


@cache
def _parts(site: str) -> np.ndarray:
    """Hashes of all parts of a site's name that could be a word of more than three letters."""
    parts = {w[a:b] for w in site.split() for a in range(len(w)) for b in range(a + 4, len(w) + 1)}
    return Words([" ".join(sorted(parts))]).hash


class Lines:
    """Columns with a value for each line of the pages; ``doc`` is the index of its page, blank lines are lines too.

    The titles are texts behind the pages.  Words that are part of the site's name and numbers are no words of their own.
    """

    def __init__(self, texts: list[str], sites: list[str], titles: list[str | None] | None = None):
        docs = len(texts)
        words = Words([*texts, *(titles or ())])
        codes, n = words.codes, len(words.codes)
        self.words, self.docs = words, docs
        breaks = np.flatnonzero(codes == 10)
        self.start, self.end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [n]))
        self.doc = np.searchsorted(words.offset, self.start, side="right") - 1
        lines = len(self.start)

        def count(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[self.end] - total[self.start]

        space = _spaces()[codes]
        solid = np.flatnonzero(~space)
        first, last = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end) - 1
        self.blank = last < first
        top = max(len(solid) - 1, 0)
        at = lambda k: codes[solid[np.clip(k, 0, top)]] if len(solid) else np.zeros(len(k), np.uint32)
        begin = solid[np.clip(first, 0, top)] if len(solid) else np.zeros(lines, np.int64)
        new = ~space & np.concatenate(([True], space[:-1]))[:n]
        pieces = count(new) if n else np.zeros(lines, np.int64)

        # words: numbers and the site's own are masked
        length = words.end - words.start
        digit = np.concatenate(([0], np.cumsum((codes >= 48) & (codes <= 57))))
        hashes = np.where(digit[words.end] - digit[words.start] == length, NUMBER, words.hash)
        owner = words.doc % max(docs, 1)
        known = [_parts(site) for site in sites]
        salt = lambda h, doc: mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15))
        own = salt(np.concatenate(known), np.repeat(np.arange(docs), [len(k) for k in known])) if docs else np.empty(0, U)
        self.hash = np.where(np.isin(salt(hashes, owner), own) & (length > 3), SITE, hashes)
        self.line = np.searchsorted(self.start, words.start, side="right") - 1
        self.first = np.searchsorted(words.start, self.start)
        self.n_words = np.bincount(self.line, minlength=lines)
        place = (np.arange(len(self.line)) - self.first[self.line]).astype(U)
        self.total = np.concatenate(([U(0)], np.cumsum(mix(self.hash * U(0x100000001B3) + place), dtype=U)))
        self.print = self.total[self.first + self.n_words] - self.total[self.first]  # of the words in order
        held = np.stack([count(codes == ord(c)) for c in SIGNS])
        signs = held.sum(axis=0)
        self.signs = np.where(held > 0, 30 + np.arange(len(SIGNS))[:, None], -1)  # tokens as words are, in all lines
        symbols = count(~space) - np.bincount(self.line, weights=length, minlength=lines).astype(np.int64)
        self.key = np.where(self.blank, U(0), mix(self.print + symbols.astype(U) * U(0x9E3779B97F4A7C15)) | U(1))

        # form
        ends = [at(last - k) for k in range(3)]
        dots = (ends[0] == ord(".")) & (ends[1] == ord(".")) & (ends[2] == ord(".")) & (last - 2 >= first)
        trailing = (ends[0] == ord("…")) | dots
        back = np.zeros(lines, np.int64)  # closing marks at the end
        for k in range(3):
            back += (back == k) & _of(at(last - k), CLOSING) & (last - k > first)
        mark = at(last - back)
        stopped, colon = _of(mark, STOPS), ends[0] == ord(":")
        follows = np.concatenate((codes[1:], [0]))[:n]
        link = count((codes == ord("]")) & (follows == ord("("))) > 0
        has_end = stopped | (mark == ord(":"))
        self.trailing, self.link = trailing & ~self.blank, link
        self.formed = has_end & ~trailing & ~colon & (pieces >= 6) & ~self.blank
        self.title_like = ((~has_end & (pieces >= 2) & (pieces <= 16)) | link | trailing) & ~self.blank
        white = np.concatenate((space, [True]))
        second = np.minimum(begin + 1, max(n - 1, 0))
        c1 = at(first)
        bullet = _of(c1, BULLETS) & white[np.minimum(begin + 1, n)]
        if len(words.start):
            one = np.clip(self.first, 0, len(words.start) - 1)
            stop = np.minimum(words.end[one], max(n - 1, 0))
            short = (length[one] <= 3) & ((hashes[one] == NUMBER) | (length[one] == 1)) & (words.start[one] == begin) & (self.n_words > 0)
            bullet |= short & _of(codes[stop], ".)") & white[np.minimum(stop + 1, n)]
        bullet &= ~self.blank
        parting = _of(codes, PARTING) & np.concatenate(([False], space[:-1]))[:n] & np.concatenate((space[1:], [False]))[:n]
        parted = np.minimum(count(parting), 3)
        before = np.concatenate(([False], self.blank[:-1] & (self.doc[1:] == self.doc[:-1])))
        after = np.concatenate((self.blank[1:] | (self.doc[1:] != self.doc[:-1]), [True]))
        self.after_blank = before | np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        size = np.searchsorted(LENGTHS, self.n_words + signs, side="right")
        end = np.select([trailing, stopped, colon], [0, 1, 2], 3)
        none = np.full(lines, -1)
        self.tags = np.stack([
            size, 10 + end, np.where(link, 15, none), np.where(bullet, 16, none), np.where(c1 == ord("#"), 17, none), np.where(parted > 0, 17 + parted, none),
            25 + 2 * before + after,
        ])
        # the different words of each line
        order = np.lexsort((self.hash, self.line))
        line, value = self.line[order], self.hash[order]
        fresh = np.concatenate(([True], (line[1:] != line[:-1]) | (value[1:] != value[:-1])))[: len(line)]
        self.of_line, self.token = line[fresh], value[fresh].view(np.int64)
        self.number = np.arange(lines) - np.searchsorted(self.doc, self.doc)

    def pages(self) -> int:
        """Lines of the pages, without the titles behind them."""
        return int(np.searchsorted(self.doc, self.docs))


def _sites(batch: pa.RecordBatch) -> list[str]:
    return [site_name(h, u) for h, u in zip(batch.column("host").to_pylist(), batch.column("url").to_pylist())]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of sample pages: page, site, line, tokens (words by hash, tags by negative numbers), and whether a sentence."""
    for batch in slices(batches, "content"):
        sites = _sites(batch)
        x = Lines(batch.column("content").to_pylist(), sites)
        full = np.flatnonzero(~x.blank)
        words = list_array(x.token, np.bincount(x.of_line, minlength=len(x.start)), pa.int64()).take(pa.array(full))
        tags = np.concatenate((x.tags, x.signs))[:, full].T
        given = list_array((-1 - tags[tags >= 0]).astype(np.int64), (tags >= 0).sum(axis=1), pa.int64())
        page, site = batch.column("result_id").take(pa.array(x.doc[full])), pa.array(sites, pa.string()).take(pa.array(x.doc[full]))
        yield pa.RecordBatch.from_arrays([page, site, pa.array(x.key[full].view(np.int64)), words, given, pa.array(x.formed[full])], names=["page", "site", "line", "words", "tags", "sentence"])


def fit(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order and their weights, from a sample of about ``SAMPLE_PAGES`` pages, which bounds them."""
    share = min(1.0, SAMPLE_PAGES / max(1, pages.select("result_id").count()))
    sample = pages.filter(F.pmod(F.xxhash64("result_id"), F.lit(1_000_000)) < share * 1_000_000)
    schema = "page string, site string, line bigint, words array<bigint>, tags array<bigint>, sentence boolean"
    lines = spread(sample.select("result_id", "host", "url", "content"), "result_id").mapInArrow(_lines, schema).persist()
    seen = lines.groupBy("line").agg(F.countDistinct("page").alias("pages"), F.countDistinct("site").alias("sites"))
    label = F.when(F.col("sites") >= SITES, 1).when((F.col("pages") == 1) & F.col("sentence"), 0)
    labelled = lines.join(seen, "line").withColumn("furniture", label).filter("furniture is not null")
    # a line counts once for each site, so that the largest sites don't rule
    labelled = labelled.dropDuplicates(["site", "line"])
    tokens = labelled.select("furniture", F.explode(F.concat("words", "tags")).alias("token")).groupBy("token")
    tokens = tokens.agg(F.sum("furniture").alias("bad"), F.sum(1 - F.col("furniture")).alias("good")).filter("good + bad >= 3")
    total = {r["furniture"]: r["count"] for r in labelled.groupBy("furniture").count().collect()}
    rows = tokens.toArrow().sort_by("token")
    lines.unpersist()
    good, bad = rows["good"].to_numpy() + 0.3, rows["bad"].to_numpy() + 0.3
    odds = np.log(good / (total.get(0, 0) + 1.0)) - np.log(bad / (total.get(1, 0) + 1.0))
    return rows["token"].to_numpy(), np.clip(odds, -CLIP, CLIP)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its lines in order: a hash of the line without numbers and site, 0 for a blank line, and bits of its form."""
    for batch in slices(batches, "content"):
        sites = _sites(batch)
        x = Lines(batch.column("content").to_pylist(), sites)
        counts = np.bincount(x.doc, minlength=batch.num_rows)
        forms = (x.formed * SENTENCE + x.title_like * TITLE).astype(np.int8)
        columns = [batch.column("key"), batch.column("page"), pa.array(sites, pa.string()), list_array(x.key.view(np.int64), counts, pa.int64()), list_array(forms, counts, pa.int8())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "page", "site", "lines", "forms"])


def hashed(pages: DataFrame) -> DataFrame:
    """``key``, ``page``, ``site``, ``lines`` and ``forms`` of each of ``pages(key, result_id, host, url, content)``; rows of one ``key`` count once."""
    rows = pages.select("key", F.xxhash64("result_id").alias("page"), "host", "url", "content")
    rows = spread(rows, "key").mapInArrow(_hashes, "key bigint, page bigint, site string, lines array<bigint>, forms array<tinyint>")
    return checkpointed(rows.withColumn("site", F.xxhash64("site")).dropDuplicates(["key"]))


def known_lines(rows: DataFrame) -> DataFrame:
    """``line`` and ``opens`` of the ``lines`` of all ``hashed`` pages that open a list of other pages, or else are known as furniture.

    A line counts once for each page of a site.
    """
    of_page = rows.groupBy("page", "site").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    of_site = of_page.select("site", F.explode("lines").alias("line")).filter("line <> 0").groupBy("line", "site").agg(F.count("*").alias("pages"))
    seen = of_site.groupBy("line").agg(F.count("*").alias("sites"), F.sum("pages").alias("pages"))
    # all that is asked of a line needs two sites
    seen = checkpointed(seen.filter(F.col("sites") >= FEW_SITES))
    known = seen.filter((F.col("sites") >= KNOWN_SITES) | (F.col("pages") >= MANY_PAGES)).select("line", F.lit(False).alias("opens"))

    shared = seen.filter(F.col("sites") >= SITES).select("line")
    place = F.col("at") + 2  # of the next line, counted from 1
    placed = rows.select("site", "lines", "forms", F.posexplode("lines").alias("at", "line")).filter(F.col("line") != 0)
    placed = placed.filter(F.get("forms", "at").bitwiseAND(SENTENCE) == 0)
    following = F.coalesce(F.try_element_at("lines", place), F.lit(0))
    title = F.coalesce(F.try_element_at("forms", place).bitwiseAND(TITLE) != 0, F.lit(False))
    placed = placed.select("line", "site", following.alias("next"), title.alias("title")).join(shared, "line", "left_semi")
    other = shared.select(F.col("line").alias("next"), F.lit(True).alias("elsewhere"))
    placed = placed.join(other, "next", "left").withColumn("opener", (F.col("title") & F.col("elsewhere").isNull()).cast("int"))
    opened = placed.groupBy("line", "site").agg(F.sum("opener").alias("openers"), F.count("*").alias("n"))
    opened = opened.groupBy("line").agg(F.sum("openers").alias("openers"), F.sum("n").alias("n"), F.count("*").alias("sites"))
    opening = opened.filter((F.col("n") >= SEEN) & (F.col("sites") >= SITES) & (F.col("openers") / F.col("n") >= OPENS)).select("line", F.lit(True).alias("opens"))

    return known.union(opening)


def marks(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``key``, ``openers`` and ``common``: the places of the ``known_lines`` of either kind of each page that has any."""
    hit = rows.select("key", F.posexplode("lines").alias("at", "line")).join(known, "line")
    at = lambda which: F.collect_list(F.when(which, F.col("at")))
    return hit.groupBy("key").agg(at(F.col("opens")).alias("openers"), at(~F.col("opens")).alias("common"))


def best_regions(scores: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [a, b) of the contiguous region of greatest sum within each page's rows, by one scan over all; a = b if no score is positive."""
    edge = np.searchsorted(doc, np.arange(docs + 1))
    far = (np.abs(scores).sum() if len(scores) else 0.0) + 1.0
    fall = doc * far  # so that no region reaches into another page
    upto = np.cumsum(scores)
    low = np.minimum.accumulate(upto - scores - fall)
    begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))[: len(scores)]
    gain = upto - fall - low
    a, b = edge[:-1].copy(), edge[:-1].copy()
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        most = np.maximum.reduceat(gain, edge[some])
        first = np.searchsorted(doc, some)
        hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(first, len(doc)))))
        best = hit[np.searchsorted(doc[hit], some)]
        good = most > 1e-9
        b[some[good]] = best[good] + 1
        a[some[good]] = begin[np.searchsorted(begin, best[good], side="right") - 1]
    return a, b


Pair = tuple[np.ndarray, np.ndarray]


def furniture(texts: list[str], titles: list[str | None], sites: list[str], weights: Pair, placed: Pair | None, known: Pair | None = None) -> Pair:
    """Pages and line indices of the lines that aren't article.

    The lines that open lists, and those known as furniture, are either ``placed``, as (page, line index) columns, or
    ``known`` by their hashes.
    """
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = Lines(texts, sites, [html.unescape(t or "") for t in titles])
    lines, docs = x.pages(), len(texts)
    tokens, weight = weights
    spot = np.searchsorted(tokens, x.token)
    held = (spot < len(tokens)) & (tokens[np.minimum(spot, max(len(tokens) - 1, 0))] == x.token) if len(tokens) else np.zeros(len(x.token), bool)
    of_word = np.bincount(x.of_line[held], weights=weight[spot[held]], minlength=len(x.start))
    words = np.bincount(x.of_line[held], minlength=len(x.start))
    of_tag, has_tag = np.zeros(TAGS), np.zeros(TAGS, dtype=bool)
    mine = tokens < 0
    mine &= tokens >= -TAGS
    of_tag[-1 - tokens[mine]], has_tag[-1 - tokens[mine]] = weight[mine], True
    summed = lambda tags: ((of_tag[tags] * (tags >= 0)).sum(axis=0), (has_tag[tags] & (tags >= 0)).sum(axis=0))
    (tag_sum, tag_count), (sign_sum, sign_count) = summed(x.tags), summed(x.signs)
    of_word, words = of_word + sign_sum, words + sign_count
    # the form of a line tells sentences; headings and lists of the article have the form of furniture, so their words decide
    score = np.where(x.formed, of_word + tag_sum - LEVEL * (words + tag_count), of_word)[:lines]
    doc, blank, formed, line = x.doc[:lines], x.blank[:lines], x.formed[:lines], np.arange(lines)
    begin = np.searchsorted(doc, np.arange(docs + 1))

    # the first line that is the page's title, or a long beginning of it
    title = np.searchsorted(x.start, x.words.offset[docs:])  # titles are lines too; one with a line break is taken to its first
    own = title[doc]
    n = x.n_words[:lines]
    upto = x.total[x.first[own] + np.minimum(n, x.n_words[own])] - x.total[x.first[own]]
    named = (n > 0) & (n <= x.n_words[own]) & (x.print[:lines] == upto) & ((n == x.n_words[own]) | (x.end - x.start > 24)[:lines]) & ~x.link[:lines]
    at = np.full(docs, lines)
    np.minimum.at(at, doc[named], line[named])
    is_title = line == at[doc]
    early = (line < at[doc]) & (at[doc] < lines)

    # lines known as furniture, those that follow a line that opens a list of other pages, and teasers: a title with the beginning of its text
    opens, other = np.zeros(lines, dtype=bool), np.zeros(lines, dtype=bool)
    if known is not None:
        opens, other = (np.isin(x.key[:lines].view(np.int64), k) & ~blank for k in known)
    else:
        for mask, (page, index) in zip((opens, other), placed):
            mask[begin[page] + index] = True
    block = np.cumsum(x.after_blank[:lines] | blank | formed | is_title)
    first = np.full(block[-1] + 1 if lines else 1, lines)
    np.minimum.at(first, block[opens], line[opens])
    listed = (line > first[block]) & ~formed & ~blank if lines else other
    other |= listed | opens
    teaser = x.trailing[1:lines] & ~blank[:-1] & ~formed[:-1] & (doc[1:] == doc[:-1]) if lines else np.zeros(0, bool)
    other[1:] |= teaser
    other[:-1] |= teaser
    score = np.where(other, np.minimum(score, -CLIP), score)
    score = np.where(is_title, HEAD, np.where(early, -BOUND, score))

    full = np.flatnonzero(~blank)
    # a list counts once in the sum, by the line that opens it, whatever its length
    scan = np.where(is_title, HEAD, np.where(listed & ~early, 0.0, np.clip(score, -BOUND, BOUND)))
    a, b = best_regions(scan[full], doc[full], docs)
    place = np.arange(len(full))
    sentence = formed[full] & (score[full] >= KEEP)
    inside = ((place >= a[doc[full]]) & (place < b[doc[full]])) | sentence
    gone = ~inside | (score[full] < np.where(formed[full], CUT_SENTENCE, CUT))
    gone &= np.bincount(doc[full], minlength=docs)[doc[full]] >= PAGE_LINES  # else a snippet
    return doc[full[gone]], line[full[gone]] - begin[doc[full[gone]]]


def _places(column: pa.Array) -> np.ndarray:
    """(row, value) of each value of a list column."""
    return np.stack([pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column).to_numpy().astype(np.int64)])


def _furniture(batches: Iterator[pa.RecordBatch], weights: Pair, known: Broadcast[Pair] | None, body: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "content"):
        texts = batch.column("content").to_pylist()
        given = (None, known.value) if known is not None else ((_places(batch.column("openers")), _places(batch.column("common"))), None)
        page, index = furniture(texts, batch.column("title").to_pylist(), _sites(batch), weights, *given)
        if not body:
            yield pa.RecordBatch.from_arrays([batch.column("result_id").take(pa.array(page)), pa.array((index + 1).astype(np.int32))], names=["result_id", "line_no"])
            continue
        edge, done = np.searchsorted(page, np.arange(len(texts) + 1)), []
        for k, text in enumerate(texts):
            gone = set(index[edge[k] : edge[k + 1]].tolist())
            done.append("\n".join(line for j, line in enumerate(text.split("\n")) if j not in gone).strip() if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("result_id"), pa.array(done, pa.string())], names=["result_id", "content"])


def _run(results: DataFrame, body: bool, schema: str) -> DataFrame:
    pages = results.filter("content is not null and result_id is not null").select("result_id", "title", "host", "url", "content")
    pages = pages.withColumn("key", F.xxhash64("result_id", "host", "url", "content"))
    full = pages.filter(F.col("content").contains("\n"))
    weights = fit(full)
    rows = hashed(full)
    lines = checkpointed(known_lines(rows))
    marked, sent = pages if body else full, None
    if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:  # no page moves then
        table = lines.toArrow()
        opens = table["opens"].to_numpy(zero_copy_only=False)
        hashes = table["line"].to_numpy()
        sent = results.sparkSession.sparkContext.broadcast((np.sort(hashes[opens]), np.sort(hashes[~opens])))
    else:
        marked = marked.join(marks(rows, lines).hint("shuffle_hash"), "key", "left")
    return spread(marked.drop("key"), "result_id").mapInArrow(partial(_furniture, weights=weights, known=sent, body=body), schema).distinct()


def furniture_lines(results: DataFrame) -> DataFrame:
    """``result_id`` and ``line_no`` of each non-blank line of ``results(result_id, title, host, url, content)`` that isn't article.

    Texts with fewer than ``PAGE_LINES`` lines that hold something are snippets and have none; null contents and null ids give no row; rows loaded
    twice count once; an empty table gives an empty result; further columns are ignored.
    """
    return _run(results, False, "result_id string, line_no int")


def main_bodies(results: DataFrame) -> DataFrame:
    """``result_id`` and ``content`` of each row without the lines that aren't article."""
    return _run(results, True, "result_id string, content string")
