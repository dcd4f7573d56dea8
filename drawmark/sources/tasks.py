"""Tasks handed over by an external database: pending rows, their file locations and the write-back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_KEY = ("th", "bbh", "fname", "docnumber", "work_seq")


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Table of the external database; filters and columns are pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def pending(tasks: DataFrame) -> DataFrame:
    return tasks.filter("isprocess = '0'").orderBy("upd_timestamp", "docnumber")


def located(tasks: DataFrame, locations: DataFrame) -> DataFrame:
    """Pending tasks with their location; deleted and closed locations do not count."""
    open_tasks = tasks.filter("isprocess = '0'").withColumnRenamed("filename", "fname")
    return open_tasks.join(locations.filter("del = 0 AND wkaid <> '3'"), list(TASK_KEY))


def with_paths(tasks: DataFrame, root: str, archive_root: str) -> DataFrame:
    return tasks.select("docnumber", F.concat_ws("/", F.lit(root), "location", "fname").alias("source_path"),
                        F.concat_ws("/", F.lit(archive_root), "work_seq", F.concat_ws("-", "th", "bbh"), "fname").alias("archive_path"))


def write_back(tasks: DataFrame, flags: DataFrame) -> DataFrame:
    """Keyed update for both tables: processed, with the recognition flag of the task's result."""
    return tasks.join(flags, "docnumber").select(*TASK_KEY, F.lit("1").alias("isprocess"), F.col("ocr_flag").alias("ocr"))
