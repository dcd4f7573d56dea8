"""Process log: rows, append sinks and the CSV mirror."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawmark.functions import names
from drawmark.settings import LOG_CSV_HEADER

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def log_rows(results: DataFrame) -> DataFrame:
    """Log row of each finished file (job_id, file_name, status, method, process_date)."""
    parts = names.parsed_name(F.col("file_name"))
    done = F.col("status") == "success"
    return results.select(
        "job_id", F.lit(None).cast("string").alias("docnumber"), parts["drawing_no"].alias("drawing_no"),
        parts["revision"].alias("revision"), F.col("file_name").alias("filename"),
        F.when(done, names.ocr_flag(F.col("method"))).otherwise("N").alias("ocr_flag"),
        F.lit(None).cast("string").alias("work_seq"), F.when(done, "success").otherwise("failed").alias("status"),
        F.date_format("process_date", ISO).alias("process_date"))


def csv_mirror(log: DataFrame) -> DataFrame:
    """Log in the column order and with the header of its CSV form; nulls become ''."""
    columns = ("process_date", "drawing_no", "revision", "filename", "ocr_flag", "status", "docnumber", "work_seq")
    return log.select(*[F.coalesce(F.col(c), F.lit("")).alias(h) for c, h in zip(columns, LOG_CSV_HEADER)])


def append_log(log: DataFrame, path: str) -> None:
    """Append to the log, one folder per day."""
    log.withColumn("day", F.substring("process_date", 1, 10)).write.mode("append").partitionBy("day").parquet(path)


def append_csv(log: DataFrame, path: str) -> None:
    csv_mirror(log).write.mode("append").option("header", True).option("encoding", "UTF-8").csv(path)
