"""Hybrid retrieval: dense and sparse top-k, fusion of ranks, reranking, context."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import token_count, words
from tessera.session import checkpointed

#: Vectors of one block of points and of one block of queries: a task multiplies one by the other.
POINTS_BLOCK, QUERIES_BLOCK = 20_000, 2_000
#: Postings of queries that may be broadcast, and the most frequent words whose counts are, at most.
BROADCAST_POSTINGS, FREQUENT = 1_000_000, 50_000
#: What stands between contents, and the answer without any.
SEPARATOR = "\n\n---\n\n"
NO_RESULTS = "I couldn't find any relevant information to answer your query."


def ranked(rows: DataFrame, k: int, key: str = "query_id", item: str = "point_id") -> DataFrame:
    """The ``k`` rows of greatest score of each key, equal scores by item, with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), item))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scores(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    if metric == "Euclid":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T, 0))
    if metric == "Manhattan":
        return -np.stack([np.abs(p - row).sum(1) for row in q])
    if metric == "Cosine":
        q, p = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, p))
    return q @ p.T


def _block(points: pa.Table, queries: pa.Table, k: int, metric: str) -> pa.Table:
    names, kinds = ["query_id", "point_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
    if not points.num_rows or not queries.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    p, q = (np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (points, queries))
    pid, qid = points["point_id"].to_numpy(), queries["query_id"].to_numpy()
    out = []
    for at in range(0, len(q), 256):
        score = _scores(q[at : at + 256], p, metric).round(6)
        least = -np.partition(-score, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1]
        row, col = np.nonzero(score >= least[:, None])  # with all that tie
        out.append((qid[at + row], pid[col], score[row, col]))
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names=names)


def dense_topk(queries: DataFrame, points: DataFrame, k: int = 10, metric: str = "Cosine") -> DataFrame:
    """``query_id, point_id, score, rank`` of the ``k`` points most similar to each query.

    Inputs: queries(query_id, vector), points(point_id, vector) with vectors of one size.  Both are cut into blocks of
    bounded size, each pair of blocks is one multiplication in one task that keeps the best only; scores have six digits.
    """
    n, m = points.count(), queries.count()
    p, q = max(1, math.ceil(n / POINTS_BLOCK)), max(1, math.ceil(m / QUERIES_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = points.select("point_id", "vector", block("point_id", p).alias("p"), all_of(q).alias("q"))
    right = queries.select("query_id", "vector", block("query_id", q).alias("q"), all_of(p).alias("p"))
    pairs = left.groupBy("p", "q").cogroup(right.groupBy("p", "q"))
    best = pairs.applyInArrow(partial(_block, k=k, metric=metric), "query_id bigint, point_id bigint, score double")
    return ranked(best, k)


def dense_topk_within(queries: DataFrame, points: DataFrame, key: str, k: int = 10, metric: str = "Cosine") -> DataFrame:
    """``dense_topk`` among the points of a query's own ``key``, with the key as a further column.

    Any number of keys is one job: each key has as many blocks as its own points and queries need.  Rows without a key
    belong to none and give no row.  An id is of one key.
    """
    size = lambda df, most, name: df.groupBy(key).agg(F.ceil(F.count("*") / F.lit(most)).alias(name))
    # a key without queries needs no block
    sizes = size(points, POINTS_BLOCK, "ps").join(size(queries, QUERIES_BLOCK, "qs"), key)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = points.join(sizes, key).select(key, "point_id", "vector", block("point_id", "ps").alias("p"), all_of("qs").alias("q"))
    queries = queries.select("query_id", F.col(key).alias(key), F.col("vector").alias("vector"))  # may be rows of points
    right = queries.join(sizes, key).select(key, "query_id", "vector", block("query_id", "qs").alias("q"), all_of("ps").alias("p"))
    pairs = left.groupBy(key, "p", "q").cogroup(right.groupBy(key, "p", "q"))
    best = pairs.applyInArrow(partial(_block, k=k, metric=metric), "query_id bigint, point_id bigint, score double")
    return ranked(best, k).join(queries.select("query_id", key), "query_id")


def postings(rows: DataFrame, key: str, sparse: str = "sparse") -> DataFrame:
    """``key, term, weight`` of each place of a sparse vector; null vectors have none."""
    pairs = F.arrays_zip(F.col(f"{sparse}.indices").alias("term"), F.col(f"{sparse}.weights").alias("weight"))
    return rows.filter(F.col(sparse).isNotNull()).select(key, F.inline(pairs)).toDF(key, "term", "weight")


def lexical_postings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, term, weight``: a lexical stand-in for a sparse model, with ln(1 + tf) of each word.

    Texts move once, by ``key``; words are counted, and later scored, where they then are.
    """
    terms = rows.select(key, text).filter(F.col(text).isNotNull()).repartition(key).select(key, F.explode(words(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.round(F.log1p(F.count("*")), 6).alias("weight"))


def sparse_topk(queries: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, point_id, score, rank`` by the inner product of postings queries(query_id, term, weight) and points(point_id, term, weight).

    Queries of at most ``BROADCAST_POSTINGS`` postings (counted) are broadcast: a point is then scored where its postings
    are, since they are partitioned by ``point_id``, and a task hands on the ``k`` best of each query only, so that neither
    a frequent term nor the pairs that share one are shuffled.  Beyond that the join is by term; a frequent term's
    partition is split at run time (adaptive skew joins).
    """
    q = queries.select("query_id", "term", F.col("weight").cast("double").alias("qw"))
    d = points.select("point_id", "term", F.col("weight").cast("double").alias("dw"))
    if q.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS:
        q = F.broadcast(q)
    scored = d.join(q, "term").groupBy("query_id", "point_id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score"))
    return ranked(scored, k)


def fuse(branches: list[DataFrame], limit: int = 10, k: int = 60) -> DataFrame:
    """``query_id, point_id, score, rank`` by the sum of 1 / (k + rank) over ranked lists, in one shuffle."""
    rows = branches[0].select("query_id", "point_id", "rank")
    for other in branches[1:]:
        rows = rows.unionByName(other.select("query_id", "point_id", "rank"))
    summed = rows.groupBy("query_id", "point_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    return ranked(summed, limit)


def lexical_score(query: Column, content: Column) -> Column:
    """A lexical stand-in for a cross-encoder: the share of the query's different words that the content has."""
    asked = F.array_distinct(words(query))
    return F.round(F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(content))) / F.size(asked)).otherwise(0.0), 6)


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """Candidates (query_id, point_id, rank, ...) by a new score, equal scores in their order before."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return candidates.withColumn("rerank_score", score).withColumn("rerank", F.row_number().over(order))


def context(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a query: the contents of its candidates in order of ``rerank`` with separators, or that there are none."""
    inner = F.array_sort(F.collect_list(F.struct("rerank", "content")))
    found = candidates.groupBy("query_id").agg(F.array_join(F.transform(inner, lambda x: x["content"]), SEPARATOR).alias("context"), F.count("*").alias("n"))
    joined = queries.select("query_id").join(found, "query_id", "left")
    return joined.select("query_id", F.coalesce("context", F.lit(NO_RESULTS)).alias("context"), F.coalesce("n", F.lit(0)).alias("n"))


def sections_text(candidates: DataFrame) -> DataFrame:
    """One row a query: its candidates as blocks under the name of their section."""
    block = F.concat(F.lit("Section: "), F.coalesce("section_path", F.lit("unknown")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    inner = F.array_sort(F.collect_list(F.struct("rerank", block.alias("block"))))
    return candidates.groupBy("query_id").agg(F.array_join(F.transform(inner, lambda x: x["block"]), "\n").alias("combined"))


def compression_target(tokens: Column, ratio: float | None, limit: int | None, most: int) -> Column:
    """Tokens that a compressed text may have."""
    if limit is not None:
        return F.lit(min(limit, most // 2))
    return F.least(F.floor(tokens * (0.5 if ratio is None else ratio)), F.lit(most // 2)).cast("int")


def compress(rows: DataFrame, key: str, text: str, ratio: float = 0.5) -> DataFrame:
    """``key`` and its text without the words most frequent in the table, in order: an extractive stand-in for a compressor.

    Of each text the ``ratio`` of its words that are rarest over all texts stay, equal ones in order of place; a text that
    keeps none gives no row.  The counts of the ``FREQUENT`` most frequent words are broadcast, so that no hot word is a
    key of the join; of other words only a text's different ones are shuffled, and ranks are found within a text's array.
    """
    cut = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    texts = rows.select(key, F.posexplode(cut).alias("at", "word")).withColumn("w", F.lower("word"))
    counted = checkpointed(texts.groupBy("w").agg(F.count("*").alias("n")))
    frequent = counted.orderBy(F.desc("n"), "w").limit(FREQUENT)
    spots = texts.join(F.broadcast(frequent), "w", "left")
    seldom = spots.filter("n is null").groupBy(key, "w").agg(F.collect_list(F.struct("at", "word")).alias("spots"))
    seldom = seldom.join(counted, "w").select(key, "n", F.inline("spots"))
    placed = spots.filter("n is not null").select(key, "n", "at", "word").union(seldom)
    gathered = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "at", "word"))).alias("words"))
    size = F.size("words")
    kept = F.slice("words", 1, F.greatest(F.floor(size * ratio).cast("int"), F.lit(0)))
    done = gathered.select(key, F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word")))).alias("kept"), size.cast("bigint").alias("words_before"))
    text_ = F.array_join(F.transform("kept", lambda x: x["word"]), " ")
    return done.filter(F.size("kept") > 0).select(key, text_.alias("compressed"), "words_before", F.size("kept").cast("bigint").alias("words_after"))


def compress_with(rows: DataFrame, key: str, text: str, compressor: Callable[[str, int], str], ratio: float | None = 0.5, limit: int | None = None, most: int = 512) -> DataFrame:
    """``key``, ``compressed``, ``tokens_before``, ``tokens_after`` and ``form`` of each text, by a function from a text and a number of tokens to a text.

    ``form`` says what came out: the compressed ``whole``; where the function failed on a text longer than ``most`` tokens,
    that of its ``truncated`` beginning; where it failed again, the ``original``.  A null text has a null ``form``.
    """
    tokens = token_count(F.col(text))
    asked = rows.select(key, F.col(text).alias("text"), compression_target(tokens, ratio, limit, most).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
                tries = [] if x is None else [("whole", x)] + [("truncated", x[: most * 4])] * (len(x) // 4 > most)
                done = (x, "original") if tries else (None, None)
                for form, given in tries:
                    try:
                        done = compressor(given, target), form
                        break
                    except Exception:  # whatever a model raises
                        continue
                out.append(done)
            texts, forms = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("text"), pa.array(texts, pa.string()), pa.array(forms, pa.string())], names=[key, "text", "compressed", "form"])

    done = asked.mapInArrow(run, f"`{key}` {asked.schema[key].dataType.simpleString()}, text string, compressed string, form string")
    return done.select(key, "compressed", token_count(F.col("text")).alias("tokens_before"), token_count(F.col("compressed")).alias("tokens_after"), "form")


def respond(asked: DataFrame, candidates: DataFrame, processor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query_id``, ``query``, ``context`` and ``n`` of each of ``asked(query_id, query)``; a ``processor`` may change the reranked candidates, as a compressor does."""
    return context(asked, processor(candidates) if processor else candidates).join(asked.select("query_id", "query"), "query_id")


def answer(contexts: DataFrame, collection: str, limit: int) -> DataFrame:
    """``query_id`` and the response to each of ``contexts(query_id, query, context)`` as one JSON object."""
    body = F.struct("query", F.lit(collection).alias("collection_name"), "context", F.lit(limit).alias("limit"))
    return contexts.select("query_id", F.to_json(body).alias("response"))
