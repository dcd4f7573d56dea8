"""Located-text strings: ``text`` followed by eight per-mille coordinates, repeated.

All work happens inside the row (one row is one page's answer), so reading needs no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions.text import clean_markup, strip
from drawmark.settings import UPSCALE_BELOW

_ENTRY = r"[^\n<]+?(?:<\|LOC_\d+\|>){8}"
_STOP_AFTER = 3


def _entries(raw: Column) -> Column:
    return F.transform(F.regexp_extract_all(raw, F.lit(_ENTRY), F.lit(0)), lambda m: F.struct(
        clean_markup(strip(F.regexp_extract(m, r"^[^\n<]+", 0))).alias("text"),
        F.transform(F.regexp_extract_all(m, F.lit(r"LOC_(\d+)"), F.lit(1)), lambda n: n.cast("int")).alias("locs")))


def _fresh(entries: Column) -> Column:
    """Entries not seen before; reading stops at the third repeat in a row."""
    start = F.struct(F.expr("CAST(array() AS array<struct<text:string,locs:array<int>>>)").alias("kept"),
                     F.lit(0).alias("repeats"), F.expr("CAST(array() AS array<int>)").alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, entry: Column) -> Column:
        stopped = acc["repeats"] >= _STOP_AFTER
        repeated = F.array_contains(acc["kept"], entry)
        skip = stopped | repeated
        return F.struct(
            F.when(skip, acc["kept"]).otherwise(F.array_append(acc["kept"], entry)).alias("kept"),
            F.when(stopped, acc["repeats"]).when(repeated, acc["repeats"] + 1).otherwise(0).alias("repeats"),
            F.when(skip, acc["at"]).otherwise(F.array_append(acc["at"], acc["i"])).alias("at"),
            (acc["i"] + 1).alias("i"))

    return F.aggregate(entries, start, step, lambda acc: F.arrays_zip(acc["kept"].alias("kept"), acc["at"].alias("at")))


def _located(pages: DataFrame, width: Column, height: Column, back: Column) -> DataFrame:
    rows = pages.withColumn("_e", F.explode(_fresh(_entries(F.col("raw")))))
    entry = F.col("_e")["kept"]

    def side(pick, first: int, size: Column) -> Column:
        picks = F.array(*[entry["locs"][i] for i in range(first, 8, 2)])
        return ((pick(picks).cast("double") / 1000 * size).cast("int") * back).cast("int")

    return rows.select("page_id", F.col("_e")["at"].alias("item"), entry["text"].alias("text"),
                       side(F.array_min, 0, width).alias("x1"), side(F.array_min, 1, height).alias("y1"),
                       side(F.array_max, 0, width).alias("x2"), side(F.array_max, 1, height).alias("y2"))


def located_texts(pages: DataFrame) -> DataFrame:
    """One row per text with its pixel box; ``item`` is its place in the raw string."""
    return _located(pages, F.col("img_w"), F.col("img_h"), F.lit(1))


def read_pages(pages: DataFrame) -> DataFrame:
    """Texts of pages that are doubled before reading where both sides are short, scaled back after."""
    small = (F.col("img_w") < UPSCALE_BELOW) & (F.col("img_h") < UPSCALE_BELOW)
    factor = F.when(small, 2).otherwise(1)
    width, height = F.col("img_w") * factor, F.col("img_h") * factor
    return _located(pages, width, height, F.col("img_w") / width)
