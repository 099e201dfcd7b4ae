"""Work that costs much a row is dealt into several tasks for each core."""

from __future__ import annotations

from skeinwork.operators.relational import spread


def test_a_task_is_not_a_whole_cores_work(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(1000, numPartitions=1), spark.range(1000, numPartitions=cores)
    assert spread(few).rdd.getNumPartitions() >= 4 * cores and spread(few).count() == 1000
    assert spread(many).rdd.getNumPartitions() == cores
