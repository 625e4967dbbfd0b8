from helpers import rows
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, FloatType
import pytest

from tessera.operators import retrieval as R
from tessera.operators.models import apply_model


def test_dense(spark):
    points = spark.createDataFrame([(k, [float(k == 1), float(k == 2), 0.5]) for k in (3, 2, 1)], "point_id bigint, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id bigint, vector array<float>")
    assert rows(R.dense_topk(asked, points, 2), "point_id", "score", "rank") == [(1, 0.894427, 1), (2, 0.0, 2)]
    assert [r[0] for r in rows(R.dense_topk(asked, points, 1, "Euclid"), "point_id")] == [1]
    assert [r[0] for r in rows(R.dense_topk(asked, points, 1, "Manhattan"), "point_id")] == [1]
    assert rows(R.dense_topk(asked, points, 1, "Dot"), "score") == [(1.0,)]
    assert R.dense_topk(asked, points.limit(0)).count() == 0 and R.dense_topk(asked.limit(0), points).count() == 0


def test_dense_in_blocks_equals_whole(spark, monkeypatch):
    df = spark.range(300).select("id", F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3))).cast("array<float>").alias("vector"))
    points, asked = df.withColumnRenamed("id", "point_id"), df.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    whole = rows(R.dense_topk(asked, points, 3))
    monkeypatch.setattr(R, "POINTS_BLOCK", 40)
    monkeypatch.setattr(R, "QUERIES_BLOCK", 10)
    assert rows(R.dense_topk(asked, points, 3)) == whole


def test_dense_within_many_keys(spark, monkeypatch, tmp_path):
    from tessera.plans import registry

    points = spark.range(2 * 1100).select(
        F.col("id").alias("point_id"), F.format_string("c%05d", F.expr("id div 2")).alias("collection_name"),
        F.array(*(F.sin((F.col("id") + 1) * k) for k in range(1, 65))).cast("array<float>").alias("dense"), F.lit("2025-01-01").cast("timestamp").alias("upserted_at"),
    )
    points.write.parquet(f"{tmp_path}/points.parquet")
    found = rows(registry.collection_topk(spark, str(tmp_path)), "query_id", "point_id")
    assert found == sorted(((k, k + j) for k in range(0, 2200, 50) for j in (0, 1)), key=repr)
    few = points.withColumnRenamed("dense", "vector").withColumn("key", F.col("point_id") % 3)
    few = few.withColumn("key", F.when(F.col("point_id") % 10 > 0, F.col("key"))).filter("point_id < 300").select("point_id", "key", "vector")
    asked = few.filter("point_id % 7 = 0").withColumnRenamed("point_id", "query_id")
    whole = rows(R.dense_topk_within(asked, few, "key", 3))
    assert {r[0] for r in whole} == {k for k in range(0, 300, 7) if k % 10}
    monkeypatch.setattr(R, "POINTS_BLOCK", 20)
    monkeypatch.setattr(R, "QUERIES_BLOCK", 5)
    assert rows(R.dense_topk_within(asked, few, "key", 3)) == whole


def test_sparse_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "point_id bigint, text string")
    asked = spark.createDataFrame([(5, "b"), (6, "zzz")], "query_id bigint, text string")
    p, q = R.lexical_postings(docs, "point_id"), R.lexical_postings(asked, "query_id")
    sparse = R.sparse_topk(q, p)
    assert rows(sparse, "query_id", "point_id", "rank") == [(5, 1, 1), (5, 2, 2)]
    dense = spark.createDataFrame([(5, 2, 1), (5, 7, 2)], "query_id bigint, point_id bigint, rank int")
    fused = R.fuse([dense, sparse], 2)
    assert [(r.point_id, r.score) for r in fused.orderBy("rank").collect()] == [(2, round(1 / 61 + 1 / 62, 6)), (1, round(1 / 61, 6))]


def test_context(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    found = spark.createDataFrame([(1, 10, 1, "a b"), (1, 11, 2, "b c"), (1, 12, 3, "b c")], "query_id bigint, point_id bigint, rank int, content string")
    ranked = R.rerank(found, R.lexical_score(F.lit("c b"), F.col("content")))
    assert rows(R.context(asked, ranked), "query_id", "context", "n") == [(1, R.SEPARATOR.join(["b c", "b c", "a b"]), 3), (2, R.NO_RESULTS, 0)]
    blocks = R.sections_text(ranked.withColumn("section_path", F.lit(None).cast("string"))).first().combined
    assert blocks.startswith("Section: unknown\nb c\n\nSection:")


def test_compress(spark):
    df = spark.createDataFrame([(1, "the rare the word"), (2, "the the"), (3, None)], "id bigint, text string")
    assert rows(R.compress(df, "id", "text"), "id", "compressed") == [(1, "rare word"), (2, "the")]
    t = df.select("id", R.compression_target(F.lit(2000), 0.5, None, 512).alias("a"), R.compression_target(F.lit(9), None, 900, 512).alias("b")).first()
    assert (t.a, t.b) == (256, 256)


def test_models(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(5)], "id int, text string")
    encoded = apply_model(df, ["text"], "dense", ArrayType(FloatType()), lambda: lambda texts: [[float(len(t))] for t in texts], 2)
    assert rows(encoded, "id", "dense") == [(k, [float(k)]) for k in range(5)]
    with pytest.raises(Exception, match="1 outputs for"):
        apply_model(df.coalesce(1), ["text"], "dense", ArrayType(FloatType()), lambda: lambda texts: [[1.0]]).collect()
    assert apply_model(df.limit(0), ["text"], "y", FloatType(), lambda: None).count() == 0


def test_answer(spark):
    asked = spark.createDataFrame([(1, "q", 1), (2, None, 1)], "query_id bigint, query string, n int")
    found = spark.createDataFrame([(1, 1, "c")], "query_id bigint, rerank int, content string")
    done = {r.query_id: r.response for r in R.answer(R.respond(asked, found), "docs", 3).collect()}
    assert done[1] == '{"query":"q","collection_name":"docs","context":"c","limit":3}' and R.NO_RESULTS in done[2]
    louder = R.respond(asked, found, lambda df: df.withColumn("content", F.upper("content")))
    assert louder.filter("query_id = 1").first().context == "C"


def test_sparse_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 7, 9))) for k in range(40)], "point_id bigint, text string")
    p = R.lexical_postings(docs, "point_id")
    q = p.filter("point_id < 5").withColumnRenamed("point_id", "query_id")
    whole = rows(R.sparse_topk(q, p, 3))
    monkeypatch.setattr(R, "BROADCAST_POSTINGS", 2)
    assert len(whole) == 15 and rows(R.sparse_topk(q, p, 3)) == whole


def test_compress_words_beyond_the_frequent(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"W{j * j % (k + 3)}" for j in range(12))) for k in range(20)], "id bigint, text string")
    whole = rows(R.compress(df, "id", "text"))
    monkeypatch.setattr(R, "FREQUENT", 3)
    assert len(whole) == 20 and rows(R.compress(df, "id", "text")) == whole


def test_compress_with_a_model(spark):
    def model(text, target):
        if len(text) > 40 or "bad" in text:
            raise RuntimeError("too long")
        return text[: target * 4]

    df = spark.createDataFrame([(1, "x" * 40), (2, "y" * 400), (3, "bad " * 5), (4, None), (5, "")], "id bigint, text string")
    found = rows(R.compress_with(df, "id", "text", model, 0.5, None, 10), "id", "compressed", "form")
    assert found == [(1, "x" * 20, "whole"), (2, "y" * 20, "truncated"), (3, "bad " * 5, "original"), (4, None, None), (5, "", "whole")]
