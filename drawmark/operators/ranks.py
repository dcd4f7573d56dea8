"""Ranks and free numbers within groups of any size.

A window over a group puts all its rows in one task. Here rows are dealt out by ranges of the order, or by blocks of
numbers, and a small table with one row per group and range or block says what comes before it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawmark.session import settled

BLOCK = 4096


def _before(parts: DataFrame, keys: Sequence[str], order: str, amount: str) -> DataFrame:
    """``parts`` with the sum of ``amount`` over the parts of the group that come before."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("bigint"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their number (from one, column ``name``) within ``keys`` (none null) by ``order``; ties in any order."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(n_parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = _before(placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n")), keys, "_part", "_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (placed.withColumn("_local", local).join(counts.drop("_n"), [*keys, "_part"])
            .withColumn(name, F.col("before") + F.col("_local")).drop("_part", "_local", "before"))


def nth_free(wanted: DataFrame, used: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``wanted`` (keys, need from one, any columns) with ``free``: the need-th number from one that ``used`` (keys, number,
    distinct and positive) does not hold.

    Before the j-th used number u there are u - j free ones, so the need-th free number is need plus the used
    numbers with u - j < need. They are counted block by block of needs."""
    keys = list(keys)
    most = wanted.groupBy(*keys).agg(F.max("need").alias("most")).join(used.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    # a number beyond all needs and used ones cannot be met
    near = used.join(most, keys).filter(F.col("number") <= F.col("most") + F.col("n")).select(*keys, "number", F.floor(F.col("number") / block).alias("cell"))
    cells = _before(near.groupBy(*keys, "cell").agg(F.count("*").alias("n")), keys, "cell", "n")
    local = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("number"))
    gaps = (near.withColumn("local", local).join(cells.drop("n"), [*keys, "cell"])
            .groupBy(*keys, (F.col("number") - F.col("before") - F.col("local")).alias("at")).agg(F.count("*").alias("n"))
            .withColumn("block", F.floor(F.col("at") / block)))
    asked = wanted.select(F.struct(*[f"`{c}`" for c in wanted.columns]).alias("row"), *keys, (F.col("need") - 1).alias("at"), F.lit(0).cast("bigint").alias("n"),
                          F.floor((F.col("need") - 1) / block).alias("block"))
    totals = gaps.groupBy(*keys, "block").agg(F.sum("n").alias("n")).unionByName(
        asked.select(*keys, "block").distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy(*keys, "block").agg(F.sum("n").alias("n"))
    heads = _before(totals, keys, "block", "n").select(*keys, "block", F.lit(-1).cast("bigint").alias("at"), F.col("before").alias("n"))
    every = asked.unionByName(gaps, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    # used numbers before the needs that they shift
    so_far = Window.partitionBy(*keys, "block").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("free", F.col("at") + 1 + F.sum("n").over(so_far)).filter("row IS NOT NULL")
    return found.select("row.*", "free")
