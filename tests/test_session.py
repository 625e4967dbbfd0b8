import types

import pytest

from tessera.session import checkpointed, shared_folder, spread


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 1)
    assert spread(many, "id") is many
    moved = spread(few, "id")
    assert moved.rdd.getNumPartitions() == cores and moved.count() == 100 and spread(few.limit(0), "id").count() == 0


def test_checkpointed(spark):
    df = checkpointed(spark.range(10).filter("id > 3"))
    assert df.count() == 6 and "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cluster_must_name_its_folder():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
