import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera.llm import scanned as S

BODY = "the archive of the museum was open and the editor wrote about the patient reader in november"
SURE = {"- 280 -": 280, "[207]": 207, "~ 38 ~": 38, "p. 378": 378, "Page 24 of 107": 24, "Vol. 33, No. 2": 0, "V0l. 3, No. 12": 0, "(l2)": 12}
PERHAPS = {"12": 12, "xxxvi": 10_036, "l2": 12, "- 12": 12, "xlix": 10_049, "1990": 1990, "l": 10_050}
NEVER = ["12 monkeys", "", "mild winter", "a", "12345", "civil", "civic", "ill", "lol", "Lo", "mild", "iix"]


@pytest.mark.parametrize("line", [*SURE, *PERHAPS, *NEVER])
def test_pages(line):
    assert S.page(line) == ((True, SURE[line]) if line in SURE else (False, PERHAPS[line]) if line in PERHAPS else None)


def test_plain_numbers_need_evidence():
    lines = ["some body text", "1990", "more of it", "civil", "My Running Head", "34", "end"]
    head = [S.fold("My Running Head")]
    assert S.furniture_lines(lines, [], set()) == set() and S.furniture_lines(lines, [], {1990, 34}) == set()
    assert S.furniture_lines(lines, head, set()) == {4, 5} and S.furniture_lines(lines, [], {34, 40}) == {5} and S.furniture_lines(lines, [], {1990, 1985}) == {1}


def test_heads():
    head = [S.fold("Cautious Survey for Yalhemmora")]
    assert S.is_head("CAUTIOUS SURVEY FOR YALHEMMORA   34", head) and S.is_head("Caut1ous Survey f0r Yalhemmora", head)
    assert not S.is_head("A cautious survey of the town", head) and not S.is_head("12", head)


def fixture(spark):
    clean = [(f"c{k}", "d0", "T > x", "text", BODY) for k in range(30)] + [("w", "d0", None, "text", "a well-known reader")] * 2
    text = "  the archiv-\n17\nMy Long Title\ne of the musevm was well-\nknown and tbe editor\nwrote in novem¬\nber h264 ab0ut the l966 reader"
    code = "x = 1\n12\nfor-\neach"
    odd = [("n", "d1", None, None, None), ("e", "d1", None, None, ""), (None, "d1", None, None, "x"), ("y", "d0", None, "text", "1966 " * 9)]
    data = [*clean, ("s", "d1", "My Long Title > Part", "text", text), ("k", "d1", None, "CODE", code), *odd]
    return spark.createDataFrame([(*r, 7) for r in data * 1 + [("s", "d1", "My Long Title > Part", "text", text)]], "id string, document_id string, section_path string, chunk_type string, content string, line_no int")


def test_defects(spark):
    found = rows(S.defects(fixture(spark)))
    assert found == [("s", 1, "split"), ("s", 2, "furniture"), ("s", 3, "furniture"), ("s", 5, "misread"), ("s", 6, "split"), ("s", 7, "misread")]


def test_repaired(spark):
    done = {r.chunk_id: r.content for r in S.repaired(fixture(spark)).collect()}
    assert done["s"] == "the archive of the musevm was well-known and the editor wrote in november h264 about the 1966 reader"
    assert done["k"].startswith("x = 1") and done["n"] is None and done["e"] == "" and done["c1"] == BODY and len(done) == 36


def test_empty(spark):
    empty = fixture(spark).limit(0)
    assert S.defects(empty).count() == 0 and S.repaired(empty).count() == 0


def test_corrections_need_a_frequent_variant(spark):
    df = spark.createDataFrame([("about", 20), ("ab0ut", 1), ("obout", 4), ("aboiit", 5), ("tar", 9), ("far", 1), ("stop", 50), ("pots", 1)], "word string, n bigint")
    assert rows(S.corrections(df)) == [("ab0ut", "about"), ("obout", "about")]


def test_two_confusions_and_learned_ones(spark):
    vocabulary = [("november", 90), ("n0vernber", 1), ("novcmbcr", 2), ("nevember", 3), ("museum", 90), ("musevm", 1)]
    df = spark.createDataFrame(vocabulary, "word string, n bigint")
    assert rows(S.corrections(df)) == [("n0vernber", "november"), ("novcmbcr", "november")]
    assert rows(S.corrections(df, df.filter("n = 1"), [("v", "u")])) == [("musevm", "museum"), ("n0vernber", "november")]


def test_confusions_are_learned_from_scans_only(spark):
    words = [f"w{''.join(chr(97 + int(d)) for d in str(k * 7919))}ua" for k in range(40)]
    data = [(w, 50, 0) for w in words]
    data += [(w.replace("u", "v"), 1, 1) for w in words[:30]]  # in scans: u is read as v
    data += [(w.replace("ua", "ea"), 1, 0) for w in words[:30]] + [(w.replace("ua", "ea") + "x", 1, 1) for w in words[:5]]  # elsewhere: other words
    found = S.learned(spark.createDataFrame(data, "word string, n bigint, scanned bigint"))
    assert found == [("v", "u")]
    assert S.learned(spark.createDataFrame([], "word string, n bigint, scanned bigint")) == []


def test_confusions_are_learned_from_every_rare_word(spark):
    letters = F.translate(F.format_string("%06d", "id"), "0123456789", "bcdfghjklm")
    rare = spark.range(300_000).select(letters.alias("word"), F.lit(1).cast("bigint").alias("n"), (F.col("id") % 2).alias("scanned"))  # half of them in scans
    words = [(f"{w}ua", 50, 0) for w in ("nopq", "rstu", "wxyz", "pqno", "turs")]  # each misread once, which is just enough
    known = spark.createDataFrame(words + [(w.replace("ua", "va"), 1, 1) for w, _, _ in words], "word string, n bigint, scanned bigint")
    assert S.learned(rare.union(known)) == [("v", "u")]


def test_spared_words_change_nothing(spark, monkeypatch):
    texts = [("a", "d1", None, "text", "the archiv-\ne of qx0rv and tbe ab0ut qx0rv a(b l966")] + [(f"c{k}", "d0", None, "text", BODY + " about the") for k in range(30)]
    df = spark.createDataFrame(texts, "id string, document_id string, section_path string, chunk_type string, content string")
    found = []
    for many in (0, 3, 20_000):
        monkeypatch.setattr(S, "SPARED", many)
        found.append(rows(S.defects(df)))
    assert found[0] == found[1] == found[2] == [("a", 1, "split"), ("a", 2, "misread")]


def test_words_that_look_like_numerals_stay(spark):
    text = "the archiv-\ne was\ncivil\nand\nciv1l\nor\nill\nlol\n1990\nof november"
    data = [("a", "d1", None, "text", text)] + [(f"c{k}", "d0", None, "text", BODY) for k in range(30)]
    df = spark.createDataFrame(data, "id string, document_id string, section_path string, chunk_type string, content string")
    assert S.repaired(df).filter("chunk_id = 'a'").first().content == "the archive was civil and civil or ill lol 1990 of november"
