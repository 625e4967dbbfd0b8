"""Queries of this subpackage: ``queries()`` and their DuckDB counterparts ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encode, leakage, mainbody, neardup, neighbours, quality, scanned, split

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.furniture_lines(_table(spark, sf_dir, "search_results"))


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_bodies(_table(spark, sf_dir, "search_results"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_point_pairs(_table(spark, sf_dir, "points"))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each point, with six digits of the similarity."""
    return neighbours.nearest(_table(spark, sf_dir, "points")).withColumn("similarity", F.round("similarity", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.defects(_table(spark, sf_dir, "chunks"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(_table(spark, sf_dir, "chunks"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("src"), "id", "content")
    results = _table(spark, sf_dir, "search_results").select(F.lit("results").alias("src"), F.col("result_id").alias("id"), "content")
    return chunks.union(results)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, sf_dir), shingle=3, threshold=0.6)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(_texts(spark, sf_dir), shingle=3, threshold=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(_table(spark, sf_dir, "chunks")).select("chunk_id", "boundary")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.split_oversized(_table(spark, sf_dir, "chunks"))
    return rows.select("chunk_id", F.inline("pieces"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks by passage or by half of the item in tiles, in whatever order."""
    found = leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


_P5_BOUNDARY = """
WITH big AS (SELECT DISTINCT id AS chunk_id, content FROM chunks WHERE length(content) // 4 > 512)
SELECT chunk_id, CASE
  WHEN len(list_filter(regexp_split_to_array(content, '[ \\t\\r]*\\n([ \\t\\r]*\\n)+'), lambda x: length(x) // 4 > 512)) = 0 THEN 'paragraph'
  WHEN len(list_filter(regexp_split_to_array(content, '\\n'), lambda x: length(x) // 4 > 512)) = 0 THEN 'line'
  WHEN len(list_filter(regexp_split_to_array(regexp_replace(content, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) // 4 > 512)) = 0 THEN 'sentence'
  WHEN len(list_filter(regexp_split_to_array(content, '[ \\t\\r\\n]+'), lambda x: length(x) // 4 > 512)) = 0 THEN 'word'
  ELSE 'none' END AS boundary
FROM big
"""

def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


_NEAREST = """
WITH l AS (SELECT point_id, dense FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY upserted_at DESC) AS n FROM points) WHERE n = 1),
v AS (SELECT point_id, dense::DOUBLE[64] AS v FROM l WHERE len(dense) = 64 AND NOT list_bool_or(list_transform(dense, lambda x: isnan(x))) AND list_sum(list_transform(dense, lambda x: abs(x))) > 0),
s AS (SELECT a.point_id AS a, b.point_id AS b, round(array_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.point_id <> b.point_id),
t AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s) WHERE n <= 5)
"""

_SIMILAR = """
WITH RECURSIVE t AS (SELECT DISTINCT 'chunks' AS src, id, content FROM chunks UNION SELECT DISTINCT 'results', result_id, content FROM search_results),
w AS (SELECT src, id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM t WHERE content IS NOT NULL),
g AS (SELECT DISTINCT src, id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT src, id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT src, id, count(*) AS n FROM g GROUP BY 1, 2),
p AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.src = b.src AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
found AS (SELECT p.src, id_a, id_b FROM p JOIN n a ON a.src = p.src AND a.id = id_a JOIN n b ON b.src = p.src AND b.id = id_b WHERE c >= 0.6 * (a.n + b.n - c))
"""

_P4_GROUPS = """,
copies AS (SELECT a.src, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.src = b.src AND a.content = b.content AND a.id < b.id),
linked AS (SELECT * FROM found UNION SELECT * FROM copies),
both_ways AS (SELECT src, id_a AS a, id_b AS b FROM linked UNION SELECT src, id_b, id_a FROM linked),
reach(src, id, other) AS (SELECT DISTINCT src, id, id FROM t WHERE content IS NOT NULL UNION SELECT r.src, r.id, l.b FROM reach r JOIN both_ways l ON l.src = r.src AND l.a = r.other)
SELECT src, id, min(other) AS group_id, count(*) AS members FROM reach GROUP BY 1, 2
"""

_P7_FOUND = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_bodies, p2_found, p2_nearest, p3_found, p3_repaired, p4_found, p4_groups, p5_found, p5_pieces, p6_ids, p7_found, p7_leaks, p8_found, p8_report)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_NEAREST} SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM t",
        "p2_nearest": f"{_NEAREST} SELECT a AS point_id, b AS neighbour_id, round(s, 6) AS similarity FROM t",
        "p4_found": f"{_SIMILAR} SELECT * FROM found",
        "p4_groups": _SIMILAR + _P4_GROUPS,
        "p5_found": _P5_BOUNDARY,
        "p7_found": _P7_FOUND,
    }
