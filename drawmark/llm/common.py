"""Shared folder, stored intermediate tables and batch limits of the training-data operators."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.session import checkpoint_dir

# Rows and bytes of text that one Arrow batch hands to a Python worker at most; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with batch limits under which a Python worker's memory does not depend on the data."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Return memory that a worker has freed to the system; between batches of texts it would otherwise stay with the
    allocators, for each of the workers of an executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


_HELD: list = [None, None]


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept in this Python worker until another key is asked for: a worker that serves one operator after
    the other holds the tables of one at a time."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        give_back()
        _HELD[:] = [key, make()]
    return _HELD[1]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; the file system removes it when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later uses neither repeat the work behind it
    nor depend on executors that may be gone."""
    path = f"{scratch_path(df.sparkSession, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores in front as long as a column of that name exists (names ignore case)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def bit_words(positions: DataFrame, n_bits: int) -> DataFrame:
    """One row with the column ``words``: ``n_bits`` bits in words of 64, those at ``positions`` (column ``p``) set.

    Words are combined in the map tasks; the last step gathers ``n_bits`` / 64 numbers, whatever the input."""
    n_words = -(-n_bits // 64)
    given = positions.filter("p IS NOT NULL").groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit_of(F.col("p"))).alias("bits"))
    every = positions.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    dense = given.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("words"))


def bit_of(position: Column) -> Column:
    """The bit of ``position`` within its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))


def bit_at(words: Column, position: Column) -> Column:
    """Whether the bit at ``position`` is set."""
    return F.element_at(words, (F.shiftright(position, 6) + 1).cast("int")).bitwiseAND(bit_of(position)) != 0


def without_keys(df: DataFrame, key: Column, keys: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one column of ``keys`` (a stored table); null keys stay.

    Only rows whose key shares a bit of a fixed-size set with one of ``keys`` go through the join, so wide rows stay
    where they are read; the join is exact."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    given = keys.toDF("_given")
    marked = stored(bit_words(given.select(F.pmod(F.xxhash64("_given"), F.lit(bits)).alias("p")), bits), "key-bits")
    maybe = F.coalesce(bit_at(marked.scalar(), at), F.lit(False)) & key.isNotNull()
    name = free_name("_key", df.columns)
    checked = df.filter(maybe).withColumn(name, key).join(given.withColumnRenamed("_given", name), name, "left_anti")
    return df.filter(~maybe).unionByName(checked.select(*[f"`{c}`" for c in df.columns]))
