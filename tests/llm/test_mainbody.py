import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mainbody as M

SENTENCES = [f"The {a} of the river town {b} its long and quiet history again in {y}." for y in range(1990, 2000) for a in ("keeper", "builder", "painter") for b in ("told", "wrote", "kept")]


def page(k, site):
    name = "".join(chr(97 + int(d)) for d in f"{k * 37:05}")
    body = SENTENCES[k % len(SENTENCES)], f"A second sentence of {name} tells what the {site} of old times had been like.", f"And a last one by {name} of the river ends the story of the town of {name} hills."
    lines = ["Skip to content", "", "Home | News | Sport", "", f"Story {k} of a town", "", body[0], "", "Advertisement", "", body[1], "", f"Heading of {name}", "", body[2], ""]
    lines += ["You may also like", f"- Another Tale {name} Told", f"- Some Town {name} Again", "", "We use cookies to measure visits. See our privacy notice.", "", f"© 2024 {site.title()}"]
    return "\n".join(lines)


def fixture(spark):
    data = [(f"p{k}", f"Story {k} of a town", f"https://site{chr(97 + k % 9)}.example/{k}", f"site{chr(97 + k % 9)}.example", page(k, f"Site{chr(97 + k % 9)}")) for k in range(80)]
    data += [("s", "t", None, None, "a snippet only"), ("n", None, None, None, None), (None, None, None, None, "x\ny\nz"), ("e", None, None, None, ""), data[3]]
    return spark.createDataFrame([(*r, 1) for r in data], "result_id string, title string, url string, host string, content string, line_no int")


def test_lines(spark):
    found = {}
    for r in M.furniture_lines(fixture(spark)).collect():
        found.setdefault(r.result_id, set()).add(r.line_no)
    assert set(found) == {f"p{k}" for k in range(80)}
    assert all(v == {1, 3, 9, 17, 18, 19, 21, 23} for v in found.values())


def test_bodies(spark):
    done = {r.result_id: r.content for r in M.main_bodies(fixture(spark)).collect()}
    assert done["p5"].startswith("Story 5 of a town") and "Heading of" in done["p5"] and "cookies" not in done["p5"] and "Another" not in done["p5"]
    assert done["s"] == "a snippet only" and done["e"] == "" and "n" not in done


def test_empty(spark):
    assert M.furniture_lines(fixture(spark).limit(0)).count() == 0


def best(scores):
    """Bounds of the region of greatest sum, by all of them: the one that ends first, and of those the shortest."""
    found = max(((sum(scores[a:b]), -b, a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    return (found[2], -found[1]) if found[0] > 0 else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), max_size=9), min_size=1, max_size=6))
def test_regions(pages):
    doc = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    a, b = M.best_regions(np.array([s for p in pages for s in p], dtype=float), doc, len(pages))
    at = 0
    for k, p in enumerate(pages):
        expected = best(p)
        found = (a[k] - at, b[k] - at)
        assert found[0] == found[1] if expected is None else sum(p[found[0] : found[1]]) == sum(p[expected[0] : expected[1]])
        at += len(p)


def test_forms_of_lines():
    x = M.Lines(["# Head\n\n- one two\n12. Three\nA whole sentence of six words.”\nthis goes on...\nNews | Sport | [More](/x)\nSee also: 5\n   \nDaily 7", ""], ["daily", ""])
    assert x.blank.tolist() == [False, True, False, False, False, False, False, False, True, False, True]
    assert np.flatnonzero(x.formed).tolist() == [4] and np.flatnonzero(x.trailing).tolist() == [5] and np.flatnonzero(x.link).tolist() == [6]
    assert (x.tags == 16).any(axis=0).nonzero()[0].tolist() == [2, 3] and (x.tags == 17).any(axis=0).nonzero()[0].tolist() == [0] and (x.tags == 19).any(axis=0).nonzero()[0].tolist() == [6]
    assert x.hash[-2:].tolist() == [int(M.SITE), int(M.NUMBER)] and (x.key == 0).tolist() == x.blank.tolist()
    assert M.Lines([], []).pages() <= 1 and len(M.furniture([], [], [], (np.empty(0, np.int64), np.empty(0)), None, (np.empty(0, np.int64),) * 2)[0]) == 0


def test_lines_are_known_from_all_pages(spark, monkeypatch):
    """Five of 200 sites share a line that has the form and words of article; no sample need show it."""
    told = "The {} keeper of the river town told its long and quiet history again."
    data = []
    for k in range(200):
        site = "site" + "".join(chr(97 + int(d)) for d in f"{k:03}")
        lines = page(k, site.title()).split("\n")
        lines[6] = told.format("".join(chr(97 + int(d)) for d in f"{k * 37:05}"))
        lines[8:8] = [told.format("other"), ""] * (k % 40 == 0)
        data.append((f"p{k}", f"Story {k} of a town", f"https://{site}.example/{k}", f"{site}.example", "\n".join(lines)))
    df = spark.createDataFrame(data, "result_id string, title string, url string, host string, content string")
    monkeypatch.setattr(M, "SAMPLE_PAGES", 40)
    found = {r.result_id for r in M.furniture_lines(df).filter("line_no = 9").collect()}
    assert found >= {f"p{k}" for k in range(0, 200, 40)}


def test_more_lines_than_may_be_broadcast(spark, monkeypatch):
    df = fixture(spark)
    whole = sorted(map(tuple, M.furniture_lines(df).collect())), sorted(map(tuple, M.main_bodies(df).collect()))
    monkeypatch.setattr(M, "BROADCAST_LINES", 0)
    assert (sorted(map(tuple, M.furniture_lines(df).collect())), sorted(map(tuple, M.main_bodies(df).collect()))) == whole
