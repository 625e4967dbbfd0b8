"""Incremental ingest: markdown files and results as streams through the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.config import Chunking
from tessera.operators.chunking import chunk_documents


def stream_table(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest_documents(documents: DataFrame, table: str, checkpoint: str, config: Chunking = Chunking()) -> StreamingQuery:
    """Chunks each micro-batch of a stream of documents(doc_id, text) and writes it under its own batch number.

    A document is chunked within its batch, so no state is kept; a batch that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch, config).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_results(results: DataFrame, key: str = "result_id", time: str = "ingested_at", delay: str = "10 days") -> DataFrame:
    """Each result of a stream once, with state bounded by a watermark."""
    return results.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def arrivals(results: DataFrame, time: str = "ingested_at", delay: str = "10 days", size: str = "1 day") -> DataFrame:
    """Results for each window of time and engine, also of a stream."""
    rows = results.withWatermark(time, delay) if results.isStreaming else results
    return rows.groupBy(F.window(time, size), F.lower("engine").alias("engine")).agg(F.count("*").alias("results")).select(
        F.col("window.start").alias("day"), "engine", "results"
    )
