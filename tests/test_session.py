"""What one task gets after a shuffle, and how wide work is spread."""
from pyspark.sql import functions as F

from drawmark.session import DRAWING_CONF, by_page, settled, tune


def test_a_task_gets_few_shuffled_bytes(spark):
    # 24 MB of numbers that do not compress; one task took them all while the size asked for was Spark's 64 MB
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k")).groupBy("k").count()
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_tables_by_page_are_written_with_zstd(spark):
    table = by_page(spark.range(100).select(F.col("id").alias("page_id")))
    assert all(".zstd." in f for f in table.inputFiles()) and table.count() == 100


def test_tables_by_page_are_read_in_order(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("page_id"), (F.col("id") % 5).alias("pos"), "id")
    table = by_page(rows, order=["pos"])
    tune(spark, drawing=True)
    try:
        counts = table.groupBy("page_id", "pos").agg(F.max("id").alias("n"))
        plan = counts._jdf.queryExecution().executedPlan().toString()
        # one group after the other: no table of groups, no sort, no exchange
        assert "SortAggregate" in plan and "Sort [" not in plan and "Exchange" not in plan
        assert sorted(counts.collect()) == sorted(rows.groupBy("page_id", "pos").agg(F.max("id").alias("n")).collect())
    finally:
        tune(spark)


def test_what_a_task_gets_does_not_grow_with_the_input(spark):
    # with two partitions a task took half of any shuffle, however large it was
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = tune(spark, drawing=True).range(3_000_000).select(F.xxhash64("id").alias("k")).groupBy("k").count()
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
        # a small shuffle is not spread, and other queries keep their own number
        assert spark.range(100).select(F.xxhash64("id").alias("k")).groupBy("k").count().select(F.spark_partition_id().alias("p")).distinct().count() == 1
        assert all(tune(spark).conf.get(key, None) != value for key, value in DRAWING_CONF.items())
    finally:
        tune(spark)
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_stored_step_leaves_no_garbage_with_the_driver(spark):
    # in runs of many steps the driver's heap grew up to its limit
    for stored in (by_page, settled):
        left = spark._jvm.java.lang.ref.WeakReference("a text that nothing else holds")
        stored(spark.range(10).select(F.col("id").alias("page_id")))
        assert left.get() is None
