"""Session settings for local runs and clusters."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Skewed pages are split at run time: the item side of a page join is cut into several tasks and the
# one-row-per-page side is copied to each, even where that costs an extra exchange afterwards.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # of shuffled bytes, which are compressed: rows of a page and a position take some 50 times as much once they are sorted or grouped
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",  # narrow rows; queries over texts take fewer
}


# For the queries on drawings only; those on training data keep Spark's own.
DRAWING_CONF = {
    # Shuffles begin with this many parts, of which AQE puts small ones together again: what a task gets does not grow with
    # the input as long as a shuffle has less than 16 GB. Below 2,000 the size of each part is known exactly.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1999",
    # tables of ``by_page`` are read in the order in which they were written, so joins and aggregates on the key stream them
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def tune(spark: SparkSession, drawing: bool = False) -> SparkSession:
    """Apply the runtime settings the operators rely on. ``drawing``: those of the queries on drawings, too."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in DRAWING_CONF.items():
        if drawing:
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("drawmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DRAWMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one that the session names. A session on one machine that names none, as in
    tests, gets one of its own, removed at exit; on a cluster that is an error, as machines do not share such a folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="drawmark-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def give_back(spark: SparkSession) -> None:
    """Lets the driver collect its garbage after a stored step: plans, broadcasts and shuffles of a step are of no use to the
    next ones, but in a run of many steps the driver's heap otherwise grows up to its limit before they go."""
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that several uses do not repeat the work behind it
    and a lost executor does not bring it back. For narrow results such as one row per page."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    give_back(df.sparkSession)
    return out


def is_by_page(df: DataFrame, key: str = "page_id") -> bool:
    """Whether ``df`` is a table of ``by_page``."""
    return getattr(df, "_bucketed_by", None) == key


def dealt(df: DataFrame, key: str = "page_id") -> DataFrame:
    """``df`` dealt by ``key`` as the tables of ``by_page`` are, but not stored; what is derived from it is placed."""
    return df if is_by_page(df, key) else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_page(df: DataFrame, key: str = "page_id", placed: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by ``key``: joins and aggregates on the key read it without
    an exchange, also together with other such tables. ``placed``: the rows are dealt by the key already, as those of
    other such tables and what is derived from them are. A table that comes from here is returned as it is.

    A key's rows are read by one task, row after row, sorted by ``order``: aggregates by the key and the first of these
    columns take one group after the other, without a table of groups or a sort."""
    if is_by_page(df, key):
        return df
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"drawmark_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    rows = df if placed else dealt(df, key)
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key, *order).saveAsTable(name)
    give_back(spark)
    table = spark.table(name)
    table._bucketed_by = key
    return table
