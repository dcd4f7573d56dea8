"""Write-back of finished tasks from a stream: keyed updates in a folder, each kept with the number of its batch."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drawmark.sources.tasks import TASK_KEY
from drawmark.streaming import jobs

UPDATE = ", ".join(f"{k} string" for k in TASK_KEY) + ", isprocess string, ocr string"


def record(updates: DataFrame, number: int, folder: str) -> None:
    """Store a batch of updates (columns of ``UPDATE``), one for each key: of several in a batch, that with the largest
    flag. A batch that comes again after a failure replaces what it wrote, so it counts once."""
    keyed = updates.select(*[F.col(k).cast("string") for k in TASK_KEY], "isprocess", "ocr")
    one = keyed.groupBy(*TASK_KEY).agg(F.max(F.struct("ocr", "isprocess")).alias("u")).select(*TASK_KEY, "u.isprocess", "u.ocr")
    one.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The update of each key from the latest batch that had it; none if nothing has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], UPDATE)
    rows = spark.read.schema(f"{UPDATE}, batch bigint").parquet(folder)
    return rows.groupBy(*TASK_KEY).agg(F.max(F.struct("batch", "ocr", "isprocess")).alias("u")).select(*TASK_KEY, "u.isprocess", "u.ocr")


def applied(table: DataFrame, updates: DataFrame, file_col: str = "filename") -> DataFrame:
    """``table`` with isprocess and ocr of its updates, other rows as they are; keys are compared as texts, null like null.

    Applying the same updates again changes nothing."""
    new = updates.select(*[F.col(k).alias(f"_{k}") for k in TASK_KEY], F.col("isprocess").alias("_isprocess"), F.col("ocr").alias("_ocr"))
    same = [F.col(file_col if k == "fname" else k).cast("string").eqNullSafe(F.col(f"_{k}")) for k in TASK_KEY]
    old = F.col("ocr") if "ocr" in table.columns else F.lit(None).cast("string")
    found = F.col("_isprocess").isNotNull()
    joined = table.join(new, same, "left")
    return joined.withColumns({"ocr": F.when(found, F.col("_ocr")).otherwise(old), "isprocess": F.coalesce("_isprocess", "isprocess")}).drop(*new.columns)


def write_back_stream(updates: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Record a stream of updates in ``folder``; without ``every`` it stops when all that is there has been read."""
    return jobs.each_batch(updates, lambda batch, number: record(batch, number, folder), "append", every)
