"""From a watched folder to the queue, as one stream: stable files get a free name and a queue row, once."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawmark.streaming import jobs, watch
from drawmark.settings import STABLE_SECONDS

QUEUED = ("source string, source_file string, file_path string, drawing_no string, revision string, status string, retry_count int, "
          "created_at timestamp, path string, run_start timestamp, batch bigint")


def queue_rows(spark: SparkSession, queue: str) -> DataFrame:
    """All rows below the folder ``queue``, with the batch that wrote them; none if nothing has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(queue)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], QUEUED)
    return spark.read.schema(QUEUED).parquet(queue)


def queue_batch(changes: DataFrame, number: int, queue: str) -> None:
    """Add the files that became stable in a batch to the queue. A batch that comes again replaces what it wrote."""
    earlier = queue_rows(changes.sparkSession, queue).filter(F.col("batch") != number)
    keys = ["path", "run_start"]
    fresh = changes.filter("stable_at IS NOT NULL").select(*keys, "stable_at").join(earlier.select(*keys), keys, "left_anti")
    taken = earlier.select(F.regexp_replace("file_path", "^processing/", "").alias("name"))
    watch.promoted(fresh, taken, keep=keys).write.mode("overwrite").parquet(f"{queue}/batch={number}")


def queue_stream(observations: DataFrame, queue: str, every: str | None = None, stable_seconds: float = STABLE_SECONDS, late: str = "1 day") -> StreamingQuery:
    """Queue the stable files of a stream of observations; without ``every`` it stops when all that is there has been read."""
    changes = watch.stable_stream(observations, stable_seconds, late=late)
    return jobs.each_batch(changes, lambda batch, number: queue_batch(batch, number, queue), "update", every)
