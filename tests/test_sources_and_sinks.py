import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import file_name
from tessera.operators import collections, export
from tessera.sources import catalogs, html, uploads
from tessera.sources.tables import latest
from tessera.streaming import ingest

NAMES = {
    "https://a.b/x/y.html?q=1": "a.b_y.html",
    "https://a.b": "a.b",
    "https://a.b/x/": "a.b_x",
    "https://a.b:8080/x": "a.b_8080_x",
    "not a url": "unknown_not a url",
    "https://a.b/" + "p" * 120: "a.b",
    "https://a.b/dots...": "a.b_dots",
    "": "unknown",
}


def test_file_names(spark):
    df = spark.createDataFrame([(u,) for u in NAMES], "url string")
    assert {r.url: r.n for r in df.select("url", file_name(F.col("url")).alias("n")).collect()} == NAMES


def test_unique_names_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "https://a.b", "x"), (2, "https://a.b", "y"), (3, None, "")], "id int, url string, markdown string")
    named = export.export_names(df, "id", F.lit("2026-01-30 19:45:36").cast("timestamp"))
    assert rows(named, "id", "file") == [(1, "20260130_194536_a.b.md"), (2, "20260130_194536_a.b_1.md"), (3, "20260130_194536_unknown.md")]
    export.write_files(named, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert export.read_file(spark, str(tmp_path / "out"), "20260130_194536_a.b_1.md", 4).first().markdown == "y"
    assert export.read_file(spark, str(tmp_path / "out"), "20260130_194536_unknown.md", 4).count() == 0


def test_numbers_of_a_hot_name(spark):
    """One base in many tasks, others in between; the numbers are those of one window over all."""
    df = spark.range(0, 5000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('b', id % 700) end as base").repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: (r.base, r.n) for r in export.numbered(df, "id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = {}
    for k in range(5000):
        base = found[k][0]
        assert found[k][1] == seen.get(base, 0)
        seen[base] = seen.get(base, 0) + 1
    assert export.numbered(df.limit(0), "id").count() == 0


def test_export_pages(spark):
    df = spark.createDataFrame([(1, "https://a.b", "<p>x"), (2, "https://a.b", ""), (3, "https://a.b", "<p>y"), (4, None, None)], "id int, url string, html string")
    done = export.export_pages(df, "id", "html")
    assert rows(done, "id", "markdown", "error", "file") == [("1", "x", None, "a.b.md"), ("2", "", "empty", None), ("3", "y", None, "a.b_1.md"), ("4", "", "empty", None)]
    assert export.saved(done).first() == (4, 2) and export.saved(done.limit(0)).first() == (0, 0)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><h1>Head &amp; more</h1><p>One <strong>two</strong> <em>three</em><p>open
<b>bold</b><ul><li>a<li>b<ol><li>c</li></ol></ul><pre><code>x = 1
y</code></pre><a href="/l">link</a><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<img src="i.png"><script>if (1) { "</p>" }</script><!-- note --><footer>end</footer></body></html>"""


def test_html(spark):
    text = html.render(PAGE)
    for part in ("# Head & more", "One **two** *three*", "- a\n- b", "1. c", "```\nx = 1\ny\n```", "[link](/l)", "| a | b |\n| --- | --- |\n| 1 | 2 |", html.IMAGE):
        assert part in text, part
    for gone in ("menu", "end", "p{}", "note", "if (1)"):
        assert gone not in text
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    assert rows(html.html_to_markdown(df, "id", "html"), "id", "error") == [("1", None), ("2", "empty"), ("3", "empty")]


def test_collections(spark, tmp_path):
    path = str(tmp_path / "points")
    chunks = spark.createDataFrame([("a", "text a", None), ("b", None, "s")], "id string, content string, section_path string")
    dense = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, dense array<float>")
    sparse = spark.createDataFrame([("a", ([1], [0.5])), ("b", ([2], [0.5]))], "id string, sparse struct<indices:array<int>,weights:array<float>>")
    points = collections.to_points(chunks, dense, sparse)
    collections.store(points, path, "one", "error")
    collections.store(points.limit(1), path, "two")
    assert collections.collection(spark, path, "one").count() == 2 and collections.collection_exists(spark, path, "two")
    with pytest.raises(ValueError):
        collections.store(points, path, "one", "error")
    (tmp_path / "broken").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        collections.collection_exists(spark, str(tmp_path / "broken"), "one")
    assert not collections.collection_exists(spark, str(tmp_path / "none"), "one")
    named = points.withColumn("document_id", F.lit("d"))
    assert rows(collections.upload_rows(named, "one")) == [("d", "one", True, 2)] and collections.upload_rows(named.limit(0), "one").count() == 0
    assert "section_path" not in collections.payload(points).filter("content = 'text a'").first().metadata
    with pytest.raises(Exception, match="no vector for chunk b"):
        collections.to_points(chunks, dense.filter("id = 'a'"), sparse).collect()


def test_uploads(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# x")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    found = {r.filename: (r.text, r.error) for r in uploads.read_markdown(spark, str(tmp_path)).collect()}
    assert found["a.MD"] == ("# x", None) and found["b.md"] == (None, "encoding") and found["c.txt"] == (None, "name")
    done = uploads.convert_files(spark, str(tmp_path), lambda b: b.decode().lower()).first()
    assert (done.filename, done.markdown, done.char_count, done.error) == ("d.pdf", "%pdf", 4, None)
    first = spark.createDataFrame([("u", 403, ""), ("v", 404, "n")], "url string, status int, html string")
    second = spark.createDataFrame([("u", "x"), ("v", "y")], "url string, html string")
    assert rows(uploads.with_fallback(first, second), "url", "html") == [("u", "x"), ("v", "n")]


def test_latest_and_catalogs(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (1, 7, "b")], "k int, t int, v string")
    assert rows(latest(df, "k", "t")) == [(1, 7, "b"), (2, None, "c")]
    assert catalogs.categories(spark).count() == 4 and catalogs.engines(spark).filter("not paged").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"# H{k}\ntext number {k}") for k in range(6)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_table(spark, str(tmp_path / "in"), docs.schema, files=1)
    ingest.ingest_documents(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from tessera.operators.chunking import chunk_documents

    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "content") == rows(chunk_documents(docs), "id", "content")


def test_config():
    assert config.load({"chunking": {"chunk_size": 256}}).chunking.max_tokens == 256
    for wrong in ({"chunking": {"overlap_tokens": 512}}, {"store": {"metric": "x"}}, {"compression": {"ratio": 1.0}}, {"fetching": {"backoff": 0.5}}, {"chunking": {"max_tokens": 600}}, {"retrieval": {"limit": 0}}):
        with pytest.raises(ValueError):
            config.load(wrong)


def test_settings_files(tmp_path):
    path = tmp_path / "settings.yaml"
    path.write_text("chunking:\n  chunk_size: 300\nqdrant:\n  distance_metric: Dot\nurl_fetching:\n  max_retries: 5\nserver:\n  port: 1\n")
    found = config.load_file(str(path))
    assert (found.chunking, found.store.metric, found.fetching.max_retries) == (config.Chunking(300, 30), "Dot", 5)
    (tmp_path / "none.json").write_text("")
    assert config.load_file(str(tmp_path / "none.json")).chunking.max_tokens == 256
    path.write_text("url_fetching:\n  retry_backoff: 0\n")
    assert config.load_fetching(str(path)) == config.Fetching() == config.load_fetching(str(tmp_path / "missing.yaml"))
    assert [config.sequence_limit(x) for x in (None, 384, 10**30)] == [512, 384, 512]
