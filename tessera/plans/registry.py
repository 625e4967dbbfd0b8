"""Queries by name: each takes a session and a directory of tables, and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, collections, export, markdown, retrieval, search
from tessera.session import checkpointed, shared_folder
from tessera.sources import catalogs, html, uploads
from tessera.sources.tables import latest, table
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def _points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest state of each point whose dense vector is usable, with ``dense`` and the columns asked for."""
    rows = latest(table(spark, d, "points"), "point_id", "upserted_at", "dense", *columns)
    return rows.filter(V.usable(F.col("dense"), 64))


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest state of each chunk, with the columns asked for."""
    return latest(table(spark, d, "chunks"), "id", "ingested_at", *columns)


def _asking(rows: DataFrame, key: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 50."""
    return rows.filter(F.col(key) % 50 == 0)


# retrieval


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(_asking(rows, "point_id").withColumnRenamed("point_id", "query_id"), rows)


def _dense(points: DataFrame) -> DataFrame:
    rows = points.select("point_id", F.col("dense").alias("vector"))
    return retrieval.dense_topk(_asking(rows, "point_id").withColumnRenamed("point_id", "query_id"), rows)


def _sparse(points: DataFrame) -> DataFrame:
    rows = retrieval.postings(points, "point_id")
    return retrieval.sparse_topk(_asking(rows, "point_id").withColumnRenamed("point_id", "query_id"), rows)


@query
def dense_topk_points(spark: SparkSession, d: str) -> DataFrame:
    return _dense(_points(spark, d))


@query
def sparse_topk_points(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(_points(spark, d, "sparse"))


@query
def sparse_postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_postings(table(spark, d, "documents"), "doc_id")


@query
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries over all documents."""
    asked = retrieval.lexical_postings(_asking(table(spark, d, "benchmark"), "item_id"), "item_id").withColumnRenamed("item_id", "query_id")
    return retrieval.sparse_topk(asked, retrieval.lexical_postings(table(spark, d, "documents"), "doc_id").withColumnRenamed("doc_id", "point_id"))


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse([_dense(_points(spark, d)), _sparse(_points(spark, d, "sparse"))])


def _reranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, query) and their fused candidates with contents, reranked."""
    points = _points(spark, d, "chunk_id").select("point_id", "chunk_id")
    chunks = _chunks(spark, d, "content", "section_path").select(F.col("id").alias("chunk_id"), "content", "section_path")
    asked = _asking(points, "point_id").join(chunks, "chunk_id", "left").select(F.col("point_id").alias("query_id"), F.coalesce("content", F.lit("")).alias("query"))
    fused = retrieval.fuse([_dense(_points(spark, d)), _sparse(_points(spark, d, "sparse"))])
    with_text = fused.join(points, "point_id").join(chunks, "chunk_id").join(asked, "query_id")
    return asked, retrieval.rerank(with_text, retrieval.lexical_score(F.col("query"), F.col("content")))


@query
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d)[1].select("query_id", "point_id", "rank", "rerank_score", "rerank")


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both rankings fused, reranked, and put together as one context for each query."""
    asked, found = _reranked(spark, d)
    return retrieval.context(asked, found)


FLAGSHIP = hybrid_search


@query
def search_answers(spark: SparkSession, d: str) -> DataFrame:
    """The flagship's contexts as responses."""
    return retrieval.answer(retrieval.respond(*_reranked(spark, d)), "documents", 10)


@query
def collection_topk(spark: SparkSession, d: str) -> DataFrame:
    """Dense top-k within each collection: a query meets the points of its own collection only; points of none take no part."""
    points = checkpointed(_points(spark, d, "collection_name").select("point_id", "collection_name", F.col("dense").alias("vector")))
    asked = _asking(points, "point_id").withColumnRenamed("point_id", "query_id")
    return retrieval.dense_topk_within(asked, points, "collection_name", 5).select("query_id", "point_id", "score", "rank", "collection_name")


@query
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sections_text(_reranked(spark, d)[1])


@query
def empty_result_message(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose engines found nothing get the fixed answer."""
    asked = table(spark, d, "search_requests").select(F.col("request_id").alias("query_id"))
    found = search.pages(table(spark, d, "search_requests"), table(spark, d, "search_results"))
    text = search.normalise(table(spark, d, "search_results")).select("result_id", "title")
    rows = found.join(text, "result_id").select(F.col("request_id").alias("query_id"), F.col("rank").alias("rerank"), F.col("title").alias("content"))
    return retrieval.context(asked, rows)


@query
def compress_targets(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.token_count(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select(
        "doc_id", tokens.alias("tokens"), retrieval.compression_target(tokens, 0.5, None, 512).alias("by_ratio"),
        retrieval.compression_target(tokens, None, 200, 512).alias("by_limit"),
    )


@query
def compress_extractive(spark: SparkSession, d: str) -> DataFrame:
    done = retrieval.compress(table(spark, d, "documents"), "doc_id", "text")
    return done.withColumn("ratio", F.round(F.col("words_after") / F.col("words_before"), 6))


@query
def query_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The hashed stand-in for a dense model, of each request's query."""
    rows = table(spark, d, "search_requests").filter("query_text is not null")
    return rows.select("request_id", F.posexplode(V.hashed_bag(F.col("query_text"))).alias("place", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@query
def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "points")
    terms = retrieval.postings(rows, "point_id").agg(F.countDistinct("term")).first()[0]  # one number
    dims = rows.groupBy(F.coalesce(F.size("dense"), F.lit(-1)).alias("dims")).agg(F.count("*").alias("points"))
    return dims.withColumn("terms", F.lit(terms).cast("bigint"))


@query
def vector_join_check(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with, and without, a usable stored point, by collection of their upload."""
    points = _points(spark, d, "chunk_id").select("chunk_id").distinct().withColumn("stored", F.lit(1))
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id").distinct()
    names = table(spark, d, "uploads").select("document_id", "collection_name").distinct()
    rows = chunks.join(points, "chunk_id", "left").join(names, "document_id", "left")
    return rows.groupBy("collection_name").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"))


# text


@query
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query
def truncate_batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate(F.col("text"), 128)).alias("truncated_md5"))


@query
def truncation_stats(spark: SparkSession, d: str) -> DataFrame:
    over = T.token_count(F.col("text")) > 512
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(over).alias("truncated"), F.coalesce(F.bool_or(over), F.lit(False)).alias("any_truncated"))


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


@query
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    found = T.sentences(F.coalesce("text", F.lit("")))
    most = F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("sentences"), most.alias("longest"))


@query
def metadata_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("content is not null").select("id", T.is_noise(F.col("content")).alias("noise")).distinct()


@query
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id").distinct().select("id", T.point_id(F.col("id")).alias("point_id"))


# markdown and chunks


@query
def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    return markdown.elements(table(spark, d, "documents"))


@query
def element_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of tables, items of lists, by document."""
    rows = markdown.elements(table(spark, d, "documents"))
    lines = F.split("content", "\n")
    columns = F.size(F.split(F.regexp_replace(F.element_at(lines, 1), r"^\s*\||\|\s*$", ""), r"\|"))
    items = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*+] |\d+\.\s)")))
    return rows.filter("type in ('table', 'list')").select("doc_id", "pos", "type", F.size(lines).alias("lines"), F.when(F.col("type") == "table", columns).otherwise(items).alias("parts"))


@query
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(markdown.elements(table(spark, d, "documents"))).select("doc_id", "pos", "type", "section_ord", "section_path", "parent_section")


@query
def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack(chunking.sections(markdown.elements(table(spark, d, "documents"), once=True)), 512)


@query
def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return chunking.link(chunk_document(spark, d))


@query
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"))


@query
def text_split_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.posexplode(chunking.split_text(F.col("text"), 128)).alias("part", "c")).select("doc_id", "part", F.md5("c.content").alias("content_md5"), F.col("c.tokens").alias("tokens"))


def _of_type(spark: SparkSession, d: str, kind: str, split: Callable) -> DataFrame:
    rows = table(spark, d, "chunks").filter((F.lower("chunk_type") == kind) & F.col("content").isNotNull()).select("id", "content").distinct()
    return rows.select("id", F.posexplode(split(F.col("content"), 64)).alias("part", "c")).select("id", "part", F.md5("c.content").alias("content_md5"), F.col("c.tokens").alias("tokens"))


@query
def table_split(spark: SparkSession, d: str) -> DataFrame:
    return _of_type(spark, d, "table", chunking.split_table)


@query
def code_split(spark: SparkSession, d: str) -> DataFrame:
    return _of_type(spark, d, "code", chunking.split_code)


@query
def list_split(spark: SparkSession, d: str) -> DataFrame:
    return _of_type(spark, d, "list", chunking.split_list)


@query
def chunk_states(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each chunk, with the token count that its content has and its place in its sequence."""
    part = F.try_to_number(F.regexp_extract("split_sequence", r"^(\d+)/(\d+)$", 1), F.lit("999999")).cast("int")
    parts = F.try_to_number(F.regexp_extract("split_sequence", r"^(\d+)/(\d+)$", 2), F.lit("999999")).cast("int")
    tokens = T.token_count(F.col("content"))
    return _chunks(spark, d, "document_id", "content", "token_count", "chunk_type", "split_sequence").select(
        "id", "document_id", F.lower("chunk_type").alias("chunk_type"), tokens.alias("tokens"),
        (~F.col("token_count").eqNullSafe(tokens)).alias("stale"), part.alias("part"), parts.alias("parts"),
    )


@query
def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Links between chunks that another chunk answers, and those that dangle."""
    rows = _chunks(spark, d, "next_chunk_id", "prev_chunk_id")
    following = rows.select(F.col("id").alias("next_chunk_id"), F.col("prev_chunk_id").alias("back"))
    joined = rows.filter("next_chunk_id is not null").select("id", "next_chunk_id").join(following, "next_chunk_id", "left")
    return joined.select("id", "next_chunk_id", F.when(F.col("back") == F.col("id"), "mutual").when(F.col("back").isNull(), "dangling").otherwise("other").alias("link"))


@query
def upload_summary(spark: SparkSession, d: str) -> DataFrame:
    """Uploads with the chunks and characters that they really have, and whether their name is accepted."""
    have = _chunks(spark, d, "document_id", "content").groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))
    rows = table(spark, d, "uploads").join(have, "document_id", "left")
    return rows.select(
        "document_id", "collection_name", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"),
        uploads.accepted(F.col("filename"), ".md").alias("is_markdown"), uploads.accepted(F.col("filename"), ".pdf").alias("is_pdf"),
    )


@query
def upload_results(spark: SparkSession, d: str) -> DataFrame:
    """What the upload of each document with stored points answers, by collection."""
    rows = latest(table(spark, d, "points"), "point_id", "upserted_at", "document_id", "collection_name").filter("document_id is not null")
    return rows.groupBy("document_id", "collection_name").agg(F.count("*").alias("points")).withColumn("success", F.lit(True))


@query
def collection_scan(spark: SparkSession, d: str) -> DataFrame:
    """The newest points stored as a table of collections, and those of the first collection by name read back from it."""
    path = f"{shared_folder(spark)}/collections-{uuid.uuid4()}"
    points = _points(spark, d, "collection_name", "chunk_id").select("point_id", "collection_name", "chunk_id", "dense")
    collections.store_all(points, path)
    name = table(spark, d, "points").agg(F.min("collection_name")).first()[0]
    return collections.collection(spark, path, name).select("point_id", "collection_name", "chunk_id", F.size("dense").alias("dims"))


@query
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many documents were asked for and how many have a file."""
    rows = table(spark, d, "documents").select("doc_id", "url", "text")
    return export.saved(export.export_pages(rows, "doc_id", "text"))


@query
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return html.html_to_markdown(table(spark, d, "documents"), "doc_id", "text")


@query
def payloads(spark: SparkSession, d: str) -> DataFrame:
    """The points of each chunk as they are served: content and metadata."""
    chunks = _chunks(spark, d, "content", "chunk_type", "section_path").select(F.col("id").alias("chunk_id"), "content", "chunk_type", "section_path")
    points = _points(spark, d, "collection_name", "chunk_id").select("point_id", "collection_name", "chunk_id")
    return collections.payload(points.join(chunks, "chunk_id"))


# search


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "search_requests"), table(spark, d, "search_results")


@query
def bang_route(spark: SparkSession, d: str) -> DataFrame:
    return search.route(_requests(spark, d)[0]).withColumn("engines", F.array_join("engines", ","))


@query
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return search.validate(_requests(spark, d)[0])


@query
def error_status(spark: SparkSession, d: str) -> DataFrame:
    return search.status(_requests(spark, d)[0])


@query
def engine_parameters(spark: SparkSession, d: str) -> DataFrame:
    return search.parameters(_requests(spark, d)[0])


@query
def result_normalise(spark: SparkSession, d: str) -> DataFrame:
    requests, results = _requests(spark, d)
    rows = search.normalise(results, requests)
    return rows.withColumn("content", F.md5("content")).withColumn("score", F.round("score", 6))


@query
def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    return search.request_body(_requests(spark, d)[0])


@query
def result_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of each result as a reader sees it."""
    rows = search.normalise(_requests(spark, d)[1])
    return rows.select("result_id", "engine", search.two_decimals(F.col("score")).alias("shown"))


@query
def websearch_page(spark: SparkSession, d: str) -> DataFrame:
    return search.pages(*_requests(spark, d)).withColumn("score", F.round("score", 6))


@query
def websearch_meta(spark: SparkSession, d: str) -> DataFrame:
    return search.responses(*_requests(spark, d))


@query
def page_bar(spark: SparkSession, d: str) -> DataFrame:
    return search.page_bar(*_requests(spark, d))


@query
def catalog_use(spark: SparkSession, d: str) -> DataFrame:
    """Categories with their engines, and the results that came from each category's engines."""
    results = search.normalise(_requests(spark, d)[1]).groupBy("engine").agg(F.count("*").alias("n"))
    by = catalogs.engines(spark).join(results, "engine", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("results"))
    known = catalogs.categories(spark).withColumn("engines", F.array_join("engines", ",")).withColumn("bangs", F.array_join("bangs", ",")).drop("examples")
    return known.join(by, "category")


@query
def bang_use(spark: SparkSession, d: str) -> DataFrame:
    """How often requests use each shortcut, also the unknown ones."""
    bang, _ = search.parse_bang(F.col("query_text"))
    used = _requests(spark, d)[0].select(bang.alias("bang")).filter("bang is not null").groupBy("bang").agg(F.count("*").alias("requests"))
    known = catalogs.bangs(spark).select("bang", "name", "engine", "category")
    return known.join(used, "bang", "full").select("bang", "name", "engine", "category", F.coalesce("requests", F.lit(0)).alias("requests"))


@query
def engine_union(spark: SparkSession, d: str) -> DataFrame:
    """Per request the engines that answered, joined, with their results and best score."""
    rows = search.normalise(_requests(spark, d)[1])
    return rows.groupBy("request_id").agg(F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines"), F.count("*").alias("results"), F.round(F.max("score"), 6).alias("best"))


@query
def gap_between_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")
    return search.gaps(rows, "user_id", "ts", 3600.0).select("event_id", "user_id", "gap", "wait")


@query
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """The waits that as many retries as a user had errors would take, five retries at most, as in the SQL counterpart."""
    errors = table(spark, d, "events").groupBy("user_id").agg(F.least(F.count_if(F.col("event_type") == "error"), F.lit(5)).cast("int").alias("attempts"))
    return search.backoff(errors, 1.0, 2.0).select("user_id", "attempts", F.aggregate("waits", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query
def export_filenames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_results").select("result_id", "url").distinct()
    return export.export_names(rows, "result_id", F.lit("2026-01-30 19:45:36").cast("timestamp")).select("result_id", "file")


@query
def export_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents rendered from HTML, with the files that they would be written to."""
    rows = table(spark, d, "documents").select("doc_id", "url", "text")
    done = export.export_pages(rows, "doc_id", "text", F.lit("2026-01-30 19:45:36").cast("timestamp"))
    return done.select("doc_id", F.md5("markdown").alias("markdown_md5"), "error", "file")


@query
def result_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return ingest.arrivals(table(spark, d, "search_results").dropDuplicates(["result_id"]))


@query
def late_results(spark: SparkSession, d: str) -> DataFrame:
    """Results by host, how many came more than a day late, and the newest."""
    rows = table(spark, d, "search_results").dropDuplicates(["result_id"])
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp")) > 86_400_000_000
    return rows.groupBy("host").agg(F.count("*").alias("results"), F.count_if(late).alias("late"), F.max("fetched_at").alias("newest"))


@query
def best_result(spark: SparkSession, d: str) -> DataFrame:
    """The best result of each request and engine."""
    rows = search.normalise(_requests(spark, d)[1])
    rank = F.row_number().over(Window.partitionBy("request_id", "engine").orderBy(F.col("score").desc(), "result_id"))
    return rows.withColumn("n", rank).filter("n = 1").select("request_id", "engine", "result_id", F.round("score", 6).alias("score"))
