"""Free numbers against plain counting."""
import random

import pytest
from pyspark.sql import functions as F

from drawmark.operators import ranks
from drawmark.streaming import watch


def nth_free(used, need):
    number = 0
    while need:
        number += 1
        need -= number not in used
    return number


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_nth_free(spark, block):
    random.seed(block)
    used = {k: set(random.sample(range(1, 60), random.randint(0, 40))) for k in "abcd"} | {"e": set(), "f": {10 ** 15, 1, 2, 70}}
    wanted = [(k, n) for k in used for n in random.sample(range(1, 120), 40)]
    got = ranks.nth_free(spark.createDataFrame(wanted, "k string, need bigint"),
                         spark.createDataFrame([(k, n) for k in used for n in used[k]], "k string, number bigint"), ["k"], block)
    assert sorted(map(tuple, got.collect())) == sorted((k, n, nth_free(used[k], n)) for k, n in wanted)


def test_numbered(spark):
    random.seed(2)
    rows = [(random.choice("aab"), random.randint(0, 40), i) for i in range(500)]
    got = ranks.numbered(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], ["v", "i"], "n").collect()
    want = {(k, v, i): n for key in "ab" for n, (k, v, i) in enumerate(sorted(r for r in rows if r[0] == key), 1)}
    assert {(r["k"], r["v"], r["i"]): r["n"] for r in got} == want
    assert ranks.numbered(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "n").collect() == []


def test_very_many_files_of_one_name(spark):
    n = 60_000
    stable = spark.range(n).select(F.concat(F.lit("d"), "id", F.lit("/x.tif")).alias("path"), F.timestamp_seconds(F.col("id") % 7).alias("stable_at"))
    number = F.col("id").cast("string")
    taken = spark.range(1, n).filter("id % 3 = 0").select(F.concat(F.lit("x_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")), F.lit(".tif")).alias("name"))
    taken = taken.unionByName(spark.createDataFrame([("x.tif",), (f"x_{'9' * 30}.tif",), ("x_1234567890123.tif",)], "name string"))
    moved = watch.promoted(stable, taken).select(F.regexp_replace("file_path", "processing/", "").alias("name")).distinct()
    assert moved.count() == n and moved.join(taken, "name").count() == 0
    # the first free numbers, without a gap
    free, k = [], 0
    while len(free) < n:
        k += 1
        if k % 3 or k >= n:
            free.append(k)
    assert moved.agg(F.max(F.regexp_extract("name", r"_(\d+)\.", 1).cast("int"))).first()[0] == free[-1]
