from helpers import rows

from tessera.llm import quality as Q

PROSE = "The editor of the paper said that it was a good year for the town, and the people of the town agreed with it."
TEXTS = {
    "prose": PROSE * 3,
    "lower case": PROSE.lower().replace(",", "").replace(".", "") * 2,
    "short lines": "\n".join(["The editor of the paper said", "that it was a good year for", "the town, and the people of it", "agreed. The rest of them was", "not asked by the paper."]),
    "prose with a list": PROSE + "\n- one\n- two\n" + PROSE,
    "prose with a tab": PROSE + "\t" + PROSE + " <|end|>",
    "bullets": "# Things\n" + "\n".join(f"- old thing {k} by Somebody" for k in range(8)),
    "numbers": "\n\n".join(f"{k}. old thing in Town{k}" for k in range(1, 9)),
    "plain list": PROSE + "\n" + "\n".join(f"old thing number {w} in Town" for w in "abcdefghijklmnop"),
    "ended entries": "\n".join(f"old thing by Some{w}, with 12 parts." for w in "abcdefgh"),
    "ended entries apart": "\n\n".join(f"key{w}: old thing by Some{w}, with 12 parts." for w in "abcdefgh"),
    "references": " ".join(f"&#{600 + k}; \\x{k % 10}f \ufffd\ufffd {k}" for k in range(30)),
    "pipes": "| a | b |\n|---|---|\n" + "| 12 | some name |\n| 13 | other name |\n" * 4,
    "tabs": "\n".join(f"name{k}\t{k * 17}\tplace{k}" for k in range(9)),
    "commas": "\n".join(f"name{k},{k * 17},place{k},{k}" for k in range(9)),
    "columns": "\n".join(f"name{k}      {k * 17}      place{k}" for k in range(9)),
    "tags": "<table>\n" + "\n".join(f"<tr><td>{k}</td><td>name {k}</td></tr>" for k in range(9)) + "\n</table>",
    "letters": "qwx zrtp kjhg vbnm lkjh poiu trew asdf gfds zxcv mnbv qwer tzui plok mjnh bgvf cdxs yaqw",
    "encoded": "\n".join("kiri1bNToc7UyXIIKwhuGUXHDwTUPivi2gjr51j3NudSGsxkm9+kRT3n8cg" for _ in range(3)),
    "symbols": "#$%^&*()_+=-[]{}|;:<>?/~` " * 8,
    "repeated": "best offer today here\n" * 12,
    "keywords": "router 2025 online dense sample template railway password translation monitor conclusion cortex online 2025 synapse",
    "blank": " \n\t",
    "empty": "",
    "null": None,
}
KINDS = {"bullets": "list", "numbers": "list", "plain list": "list", "ended entries": "list", "ended entries apart": "list", "references": "junk", "pipes": "table", "tabs": "table", "commas": "table", "columns": "table", "tags": "table",
         "letters": "junk", "encoded": "junk", "symbols": "junk", "repeated": "junk", "keywords": "junk"}


def frames(spark):
    common = "the of and a it was for that said in not by with to".split()
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS.values())], "doc_id bigint, text string, n_words int")
    return docs, spark.createDataFrame([("en", w) for w in common] + [("de", "der"), (None, None)], "lang string, word string")


def test_kinds(spark):
    names = list(TEXTS)
    assert {names[r.doc_id]: r.kind for r in Q.not_prose(*frames(spark)).collect()} == KINDS


def test_statistics(spark):
    found = {list(TEXTS)[r.doc_id]: r for r in Q.quality_report(*frames(spark)).collect()}
    assert len(found) == len(TEXTS)
    row = found["short lines"]
    assert (row.n_lines, row.n_words, row.kind) == (5, 31, "prose") and round(row.end_punctuation_ratio, 2) == 0.2
    assert found["null"].n_words == 0 and found["null"].kind == "blank" and found["blank"].n_lines == 0
    assert found["bullets"].bullet_ratio == 8 / 9 and "mostly_list" in found["bullets"].reasons and "f_line_ends" in found["bullets"].reasons
    assert "repeated_lines" in found["repeated"].reasons and "g_duplicate_lines" in found["repeated"].reasons and found["prose"].reasons == []
    assert all((row.kind in ("prose", "blank")) != bool(set(row.reasons) & set(Q.OWN)) for row in found.values())


def test_published_statistics(spark):
    texts = ["one two... three… 4 5\nsix # seven ...\nsix # seven ...", "a" * 40, "#", "...."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in Q.text_statistics(docs, frames(spark)[1]).collect()}
    row = found[0]
    assert (row.n_words, row.hash_ratio, row.ellipsis_ratio, row.ellipsis_line_ratio, round(row.alphabetic_word_ratio, 4)) == (9, 2 / 9, 4 / 9, 2 / 3, round(7 / 9, 4))
    assert row.under_30_ratio == 1 and found[1].under_30_ratio == 0 and round(row.duplicate_line_chars, 3) == round(12 / 41, 3)
    assert found[3].ellipsis_line_ratio == 1 and found[2].n_words == 0 and row.common_words == 0


def test_empty(spark):
    docs, common = frames(spark)
    assert Q.not_prose(docs.limit(0), common).count() == 0 and Q.text_statistics(docs, common.limit(0)).count() == len(TEXTS)
