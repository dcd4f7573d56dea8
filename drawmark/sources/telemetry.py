"""Device telemetry: comma-separated lines of ten fields."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions.text import strip


def _number(value: Column) -> Column:
    text = strip(value)
    return F.coalesce(F.when(~text.isin("", "[N/A]", "N/A"), text.try_cast("double")), F.lit(0.0))


def device_rows(lines: DataFrame) -> DataFrame:
    """Typed rows; unreadable numbers are 0, memory is in GB, lines with too few fields are dropped."""
    parts = lines.withColumn("p", F.split(strip(F.col("line")), ",")).filter(F.size("p") >= 10)
    n = [_number(F.col("p")[i]) for i in range(10)]
    return parts.select(
        "line_id", strip(F.col("p")[0]).alias("name"), n[1].cast("int").alias("index"), n[2].alias("temperature"), n[3].alias("load"),
        F.round(n[4] / 1024, 1).alias("memory_used"), F.round(n[5] / 1024, 1).alias("memory_total"), n[6].alias("fan_speed"),
        n[7].alias("clock_speed"), n[8].alias("power_draw"), n[9].alias("power_limit"))
