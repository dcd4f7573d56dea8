"""Column functions for reports and status displays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_decimals(value: Column, digits: int) -> Column:
    """Decimal text, halves rounded away from zero."""
    return F.format_string(f"%.{digits}f", F.round(value, digits).cast("double"))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%dm %02ds", F.floor(whole / 60).cast("bigint"), whole % 60)


def byte_size(size: Column) -> Column:
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 * 1024, F.concat(fixed_decimals(size / 1024, 0), F.lit(" KB")))
            .otherwise(F.concat(fixed_decimals(size / (1024 * 1024), 1), F.lit(" MB"))))


def temperature_band(value: Column) -> Column:
    return F.when(value < 50, "emerald").when(value < 80, "amber").otherwise("rose")


def load_band(value: Column) -> Column:
    return F.when(value < 30, "emerald").when(value < 70, "amber").otherwise("rose")


def shown_progress(phase: Column, current: Column, total: Column) -> Column:
    share = (F.when(phase == "processing", current / total)
             .when(phase == "warming_up", F.lit(0.05)).otherwise(F.lit(0.02)))
    return F.when(total > 0, F.floor(share * 100 + 0.5)).otherwise(F.lit(0)).cast("int")


def found_in(query: str, *cols: Column) -> Column:
    """Case-insensitive search in any of the columns; a blank query finds everything."""
    if not query.strip():
        return F.lit(True)
    out = F.lit(False)
    for c in cols:
        out = out | F.lower(c).contains(query.lower())
    return out
