"""Tables of a directory, in the states that queries want."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each key, by partial aggregation: a key with very many rows isn't gathered in one task."""
    rest = [c for c in columns or df.columns if c not in (key, order)]
    newest = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("newest"))
    return newest.select(key, f"newest.{order}", *(f"newest.{c}" for c in rest))
