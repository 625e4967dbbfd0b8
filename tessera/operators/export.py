"""Pages to named markdown files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import file_name
from tessera.session import checkpointed
from tessera.sources.html import html_to_markdown

#: Folders that exported files are spread over.
BUCKETS = 256


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``place``, the number of a row within its ``base``, to rows sorted by it."""
    last, given = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        base = batch.column("base")
        new = np.concatenate(([base[0].as_py() != last], pc.not_equal(base[1:], base[:-1]).to_numpy(zero_copy_only=False)))
        begin = np.flatnonzero(new)
        at = np.arange(batch.num_rows)
        group = np.cumsum(new) - 1
        place = np.where(group < 0, at + given, at - begin[group] if len(begin) else at)
        last, given = base[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows(base, ...)`` with ``n``, the number of a row among those of its ``base`` by ``order``, from 0.

    A base may have any number of rows: they are spread over tasks by ranges of ``order``, counted there, and the counts
    of a base's ranges before are added.  Only a base that goes on in a further task has such a count, so these are fewer
    than there are tasks and are broadcast.
    """
    placed = rows.repartitionByRange("base", order).sortWithinPartitions("base", order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = checkpointed(placed.mapInArrow(_places, f"{kinds}, place bigint").withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("base", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("base", "part", before.alias("before")).filter("before > 0")
    joined = placed.join(F.broadcast(before), ["base", "part"], "left")
    return joined.withColumn("n", F.col("place") + F.coalesce("before", F.lit(0))).drop("place", "part", "before")


def export_names(pages: DataFrame, order: str, stamp: Column | None = None) -> DataFrame:
    """``pages(url, ...)`` with ``file``: a safe name, after a time stamp if one is given; of the same name the second gets ``_1`` and so on.

    Numbers follow ``order``, which has no ties.  A null url counts as unreadable and gets the name of an unknown host.
    """
    name = file_name(F.coalesce("url", F.lit("")))
    base = F.concat_ws("_", F.date_format(stamp, "yyyyMMdd_HHmmss"), name) if stamp is not None else name
    rows = numbered(pages.withColumn("base", base), order)
    file = F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), "n")).otherwise(""), F.lit(".md"))
    return rows.select(*pages.columns, file.alias("file"))


def export_pages(pages: DataFrame, key: str, html: str, stamp: Column | None = None) -> DataFrame:
    """``pages(key, url, html)`` rendered and named: key, url, markdown, error and ``file``, null where there is no markdown.

    A page that can't be read has empty markdown and an error; the others are not concerned.  Pages without markdown take
    no number from those that have some.
    """
    rendered = html_to_markdown(pages, key, html, "url")
    name = file_name(F.coalesce("url", F.lit("")))
    base = F.concat_ws("_", F.date_format(stamp, "yyyyMMdd_HHmmss"), name) if stamp is not None else name
    # pages without markdown come before all names and get none
    rows = numbered(rendered.withColumn("base", F.when(F.length("markdown") > 0, base).otherwise("")), key)
    file = F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), "n")).otherwise(""), F.lit(".md"))
    return rows.select(key, "url", "markdown", "error", F.when(F.col("base") != "", file).alias("file"))


def saved(pages: DataFrame) -> DataFrame:
    """One row: the pages asked for, and those that have a file."""
    return pages.agg(F.count("*").alias("pages"), F.count("file").alias("saved"))


def write_files(pages: DataFrame, directory: str, buckets: int = BUCKETS) -> None:
    """The non-empty ``markdown`` of ``pages(file, markdown)``, spread over ``buckets`` folders by a hash of the file's name, committed as one job."""
    rows = pages.filter(F.length("markdown") > 0).select("file", "markdown").withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
    rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("markdown"), F.lit(8))).write.partitionBy("bucket").mode("errorifexists").parquet(directory)


def read_file(spark: SparkSession, directory: str, file: str, buckets: int = BUCKETS) -> DataFrame:
    """The ``file`` and ``markdown`` of one file that ``write_files`` wrote; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(file)), F.lit(buckets)).cast("int")
    return spark.read.parquet(directory).filter((F.col("bucket") == bucket) & (F.col("file") == file)).select("file", "markdown")
