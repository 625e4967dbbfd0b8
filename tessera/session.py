"""The Spark session and where it may keep checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", name: str = "tessera", **conf: str) -> SparkSession:
    """A session in one JVM for tests and benchmarks; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables in between, which the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one process, as in tests, a folder of this machine is taken; on a
    cluster without the setting it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself, or, if it comes in fewer partitions than there are cores, as a small file does, spread over them by ``keys``.

    For steps that cost far more than moving their rows; a table of a cluster's size has more partitions and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
