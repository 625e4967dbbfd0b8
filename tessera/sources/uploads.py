"""Uploaded files: markdown as text, other formats through a converter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def accepted(name: Column, suffix: str) -> Column:
    """Whether a file's name ends in a suffix, in whatever case; null and empty names are rejected."""
    return F.coalesce(F.lower(name).endswith(suffix) & (F.length(name) > 0), F.lit(False))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``filename``, ``text`` and ``error`` of all files below a path: those that aren't named ``.md`` or aren't UTF-8 have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    valid = F.expr("is_valid_utf8(cast(content as string))")
    error = F.when(~accepted(name, ".md"), "name").when(~valid, "encoding")
    return files.select(name.alias("filename"), F.when(error.isNull(), F.col("content").cast("string")).alias("text"), error.alias("error"))


def convert_files(spark: SparkSession, path: str, convert: Callable[[bytes], str], suffix: str = ".pdf") -> DataFrame:
    """``filename``, ``markdown``, ``char_count`` and ``error`` of files of another format, by a function from bytes to markdown.

    No converter of PDF comes with this package; the caller brings one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").filter(accepted(F.col("filename"), suffix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, errors = [], []
            for content in batch["content"]:
                try:
                    done.append(convert(bytes(content)))
                    errors.append(None)
                except Exception as error:
                    done.append("")
                    errors.append(type(error).__name__)
            yield pd.DataFrame({"filename": batch["filename"], "markdown": done, "error": errors})

    found = files.mapInPandas(run, "filename string, markdown string, error string")
    return found.select("filename", "markdown", F.length("markdown").alias("char_count"), "error")


def with_fallback(first: DataFrame, second: DataFrame, key: str = "url", statuses: tuple[int, ...] = (401, 403, 429)) -> DataFrame:
    """Fetched pages(url, status, html), and for those that a server refused the page fetched another way."""
    other = second.select(key, F.col("html").alias("other"))
    refused = F.col("status").isin(*statuses)
    return first.join(other, key, "left").select(key, "status", F.when(refused, F.coalesce("other", "html")).otherwise(F.col("html")).alias("html"))
