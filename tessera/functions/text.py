"""Column functions on text: tokens, sentences, noise, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of sections that hold no content, and verbs that tell prose from headings.
NOISE_MARKERS = [
    "references\n", "bibliography\n", "notes\n", "acknowledgement", "acknowledgment", "table of contents", "list of figures", "appendix", "glossary",
]
NOISE_VERBS = ["is", "are", "was", "were", "has", "have", "can", "will", "shows", "indicates", "describes"]
#: Patterns of citations.
CITATIONS = [r"\([12]\d{3}\)", r"[A-Z][a-z]+,?\s+[A-Z]\.", r"et al\."]
SENTENCE = r"[^.!?\n]+[.!?]*"
SPACES = " \t\r\u00a0"


def token_count(text: Column) -> Column:
    """Tokens of a text by the rule of four characters; null for null."""
    return F.floor(F.length(text) / 4).cast("int")


def truncate(text: Column, most: int) -> Column:
    """A text of at most ``most`` tokens."""
    return F.when(token_count(text) > most, F.substring(text, 1, most * 4)).otherwise(text)


def sentences(text: Column) -> Column:
    """Trimmed sentences of a text; none for blank ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s, F.lit(SPACES))), lambda s: F.length(s) > 0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_noise(text: Column) -> Column:
    """Whether a text is a reference list, a table of contents or the like rather than content."""
    lower = F.lower(text)
    head = F.substring(lower, 1, 100)
    marked = None
    for marker in NOISE_MARKERS:
        marked = head.contains(marker) if marked is None else marked | head.contains(marker)
    cited = sum((F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in CITATIONS), F.lit(0))
    tokens = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    capital = F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}"))) / F.size(tokens)
    verbs = F.arrays_overlap(F.transform(tokens, F.lower), F.array(*map(F.lit, NOISE_VERBS)))
    long = F.length(text) >= 20
    return F.coalesce(long & (marked | (cited > 3) | (F.size(tokens) == 0) | ((capital > 0.6) & ~verbs)), F.lit(False))


def file_name(url: Column, most: int = 100) -> Column:
    """A safe name for a page's file: its host, and the last part of its path if both are short enough."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    host = F.when(host == "", "unknown").otherwise(host)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/"), -1)
    both = F.concat(host, F.lit("_"), last)
    name = F.when((last != "") & (F.length(both) <= most), both).otherwise(host)
    name = F.regexp_replace(F.substring(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), 1, most), r"[. ]+$", "")
    return F.when(name.isin("", "_") | name.isNull(), "exported_content").otherwise(name)


def stable_id(*parts: Column) -> Column:
    """An id that is the same in each run."""
    return F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))


def point_id(chunk_id: Column) -> Column:
    """A non-negative number of 60 bits from an id."""
    return F.conv(F.substring(F.md5(chunk_id), 1, 15), 16, 10).cast("bigint")
