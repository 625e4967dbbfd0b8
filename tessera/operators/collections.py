"""Collections of stored points: one partitioned table, written atomically."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import point_id


def to_points(chunks: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Chunks joined with their vectors by ``id``; a chunk without one of them is an error of the job.

    Inputs: chunks(id, ...), dense(id, dense), sparse(id, sparse).  Adds ``point_id``.
    """
    joined = chunks.join(dense.select("id", "dense"), "id", "left").join(sparse.select("id", "sparse"), "id", "left")
    lacks = F.col("dense").isNull() | F.col("sparse").isNull()
    checked = F.when(lacks, F.raise_error(F.concat(F.lit("no vector for chunk "), "id"))).otherwise(F.col("id"))
    return joined.withColumn("id", checked).withColumn("point_id", point_id(F.col("id")))


def store(points: DataFrame, path: str, collection: str, exists: str = "append") -> None:
    """Points appended to a collection in the table at ``path``; with ``exists="error"`` a collection that has points is an error."""
    if exists == "error" and collection_exists(points.sparkSession, path, collection):
        raise ValueError(f"collection {collection} exists")
    store_all(points.withColumn("collection_name", F.lit(collection)), path)


def store_all(points: DataFrame, path: str) -> None:
    """Points of any number of collections, by their ``collection_name``, appended to the table at ``path`` in one job.

    Adaptive execution splits a large collection over tasks and joins small ones; rows without a name belong to none.
    """
    rows = points.filter("collection_name is not null")
    rows.hint("rebalance", "collection_name").write.partitionBy("collection_name").mode("append").parquet(path)


def collection_exists(spark: SparkSession, path: str, collection: str) -> bool:
    """Whether a collection has points in the table at ``path``; false where there is no table yet, any other fault is raised."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return not stored.filter(F.col("collection_name") == collection).limit(1).isEmpty()


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The points of a collection; only its partition is read."""
    return spark.read.parquet(path).filter(F.col("collection_name") == name)


def upload_rows(points: DataFrame, collection: str) -> DataFrame:
    """``document_id``, ``collection_name``, ``success`` and ``chunks`` of each document among the points stored."""
    rows = points.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return rows.select("document_id", F.lit(collection).alias("collection_name"), F.lit(True).alias("success"), "chunks")


def payload(points: DataFrame) -> DataFrame:
    """``point_id``, ``content`` and all other columns but the vectors as one JSON object without nulls."""
    rest = [c for c in points.columns if c not in ("point_id", "content", "dense", "sparse")]
    return points.select("point_id", "content", F.to_json(F.struct(*rest)).alias("metadata"))
