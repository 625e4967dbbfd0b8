from helpers import rows
from pyspark.sql import functions as F

from tessera.operators import search as S

REQUEST = "request_id bigint, query_text string, category string, engines array<string>, engine string, page int, per_page int, time_range string"


def requests(spark, *given):
    base = dict(query_text="x", category=None, engines=None, engine=None, page=1, per_page=10, time_range=None)
    data = [tuple((dict(base, request_id=k) | g)[c.split()[0]] for c in REQUEST.split(", ")) for k, g in enumerate(given)]
    return spark.createDataFrame(data, REQUEST)


def test_route(spark):
    df = requests(
        spark,
        dict(query_text="!gos climate  change", category="news", engines=["reddit"]),
        dict(query_text="!books quantum physics", engines=["arxiv"]),
        dict(query_text="!gh x"),
        dict(query_text="!ol"),
        dict(query_text=None, engine="arxiv"),
        dict(query_text="!", engines=[]),
        dict(query_text="!OL x", engines=[], engine="reddit"),
    )
    got = {r.request_id: (r.query, r.category, r.engines, r.error) for r in S.route(df).collect()}
    assert got[0] == ("climate  change", "science", ["google scholar"], None)
    assert got[1] == ("quantum physics", "books", ["arxiv"], None)
    assert got[2][3] == "unknown_bang" and got[5][3] == "unknown_bang" and got[6][3] == "unknown_bang"
    assert got[3] == ("", "books", ["openlibrary"], None)
    assert got[4] == (None, None, ["arxiv"], None)


def test_validation_and_status(spark):
    df = requests(spark, {}, dict(page=0), dict(per_page=101), dict(category="it"), dict(time_range="week"), dict(query_text=None), dict(query_text="!gh x"), dict(page=None))
    assert [r.reasons for r in S.validate(df).orderBy("request_id").collect()] == ["", "page", "per_page", "category", "time_range", "query", "", "page"]
    assert [r.status for r in S.status(df).orderBy("request_id").collect()] == [200, 422, 422, 422, 422, 422, 400, 422]
    kinds = spark.createDataFrame([("bang",), ("timeout",), ("http:418",), ("connection",), ("other",)], "k string")
    assert [r[0] for r in kinds.select(S.status_of_error(F.col("k"))).collect()] == [400, 504, 418, 503, 500]


def results(spark, n, request=0, engine="arxiv"):
    data = [(f"r{k:03}", request, None, None, None, engine, float(k % 3), "", None) for k in range(n)]
    return spark.createDataFrame(data * 2, "result_id string, request_id bigint, title string, url string, content string, engine string, score double, category string, host string")


def test_pages_join_to_the_whole_ranking(spark):
    df = results(spark, 7)
    seen = []
    for page in (1, 2, 3, 4):
        asked = requests(spark, dict(page=page, per_page=3))
        shown = S.pages(asked, df).orderBy("rank").collect()
        seen += [r.result_id for r in shown]
        meta = S.responses(asked, df).first()
        assert (meta.number_of_results, meta.has_next, meta.has_previous) == (7, len(shown) == 3, page > 1)
    assert seen == ["r002", "r005", "r001", "r004", "r000", "r003", "r006"]


def test_engines_without_pages(spark):
    asked = requests(spark, dict(query_text="!re x", page=2, per_page=3))
    df = results(spark, 5, engine="Reddit")
    assert S.parameters(asked).first().pageno is None
    assert S.pages(asked, df).count() == 3 and S.responses(asked, df).first().has_next is False
    assert S.responses(asked, df.limit(0)).first().number_of_results == 0
    assert S.page_bar(asked, df.limit(0)).first().total_pages == 1


def test_normalise(spark):
    row = S.normalise(results(spark, 1)).first()
    assert (row.title, row.category, row.score) == ("", "general", 0.0)
    asked = requests(spark, dict(query_text="x", category="science"))
    assert S.normalise(results(spark, 1), asked).first().category == "science"


def test_what_clients_send_and_readers_see(spark):
    df = requests(spark, dict(query_text="x", category="", engines=[], page=2, per_page=5), dict(query_text="y", category="it", engines=["a"], page=1, per_page=5), dict(query_text=None))
    assert rows(S.request_body(df), "body") == [('{"query":"x","page":2,"per_page":5}',), ('{"query":"y","page":1,"per_page":5,"category":"it","engines":["a"]}',)]
    shown = spark.createDataFrame([(0.0,), (0.125,), (12.3,), (1.999,)], "score double").select(S.two_decimals(F.col("score")).alias("s"))
    assert [r.s for r in shown.collect()] == ["0.00", "0.13", "12.30", "2.00"]


def test_engines_taken_out_and_queries_rewritten(spark):
    df = requests(spark, dict(query_text="!ol A B", engines=["arxiv", "reddit"]), dict(engines=["reddit"]))
    assert [r[0] for r in df.select(S.without_engine(F.col("engines"), "reddit")).collect()] == [["arxiv"], None]
    assert S.route(df, F.lower).filter("request_id = 0").first().query == "a b"


def test_backoff_and_gaps(spark):
    df = spark.createDataFrame([(0,), (3,)], "attempts int")
    assert [list(r.waits) for r in S.backoff(df, 1.0, 2.0).orderBy("attempts").collect()] == [[], [1.0, 2.0, 4.0]]
    times = spark.sql("select 1 as k, timestamp'2025-01-01 00:00:00' as t union all select 1, timestamp'2025-01-01 00:00:03'")
    assert rows(S.gaps(times, "k", "t", 5.0), "gap", "wait") == [(3.0, 2.0), (None, 0.0)]
