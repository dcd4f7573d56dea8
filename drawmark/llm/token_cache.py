"""Token counts with a cache of digests.

The cache is a Parquet folder with one row per (content digest, tokenizer version digest). Documents ask for their
digests; digests without a stored count are encoded, one text each, and their counts are appended. Counts of another
tokenizer version are never read, as the version is a partition of the folder. The content is the text as it is, with
null as empty: a tokenizer may tell apart anything that a stronger normalisation would fold.

Digests, not texts, meet the cache. A text moves once, and only if its digest is (or shares a bit of a fixed-size set
with) a miss; copies are dropped in the map tasks before it does."""
from __future__ import annotations

import hashlib

import pandas as pd
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.common import bit_at, bit_words, free_name, give_back, stored
from drawmark.llm.encode import encoder

LIMIT = 1024
_BITS = 1 << 22
_ROWS = "digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a version, one row per digest; none if the folder does not exist."""
    folder = f"{cache}/tokenizer={version}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ROWS)
    # two runs that met the same new text may both have appended it
    return spark.read.schema(_ROWS).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _place(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(_BITS))


def fill_cache(docs: DataFrame, path: str, cache: str, text_col: str = "text") -> int:
    """Encode the distinct texts of ``docs`` that the cache does not know and append them; returns their number."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    misses = stored(texts.select("digest").distinct().join(cached_counts(spark, cache, version).select("digest"), "digest", "left_anti"), "misses")
    n = misses.count()
    if not n:
        return 0
    bits = stored(bit_words(misses.select(_place("digest").alias("p")), _BITS), "miss-bits")

    @F.pandas_udf("bigint")
    def count(batch: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        give_back()
        return pd.Series([len(encode(t)) // 4 for t in batch], dtype="int64")

    wanted = texts.filter(bit_at(bits.scalar(), _place("digest"))).dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
    wanted.select("digest", count("text").alias("n_tokens")).write.mode("append").parquet(f"{cache}/tokenizer={version}")
    return n


def token_counts(docs: DataFrame, path: str, cache: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (of the text as UTF-8), n_tokens and over_limit (existing columns of these names are
    replaced, except the text). ``path``: a tokenizers file that exists on all machines; ``cache``: a folder that all
    machines share.

    Counts are those of the library without added special tokens, truncation or padding. Null and empty texts have no
    bytes and no tokens. Repeated rows are counted alike; an empty table gives an empty result."""
    fill_cache(docs, path, cache, text_col)
    # stored, so that both sides of the join are dealt out for it alone and a text of very many copies is split
    known = stored(cached_counts(docs.sparkSession, cache, tokenizer_version(path)), "counts")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c == text_col or c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    name = free_name("_digest", [*kept, "n_bytes", "n_tokens", "over_limit"])
    rows = docs.withColumns({name: F.unhex(F.sha2(text, 256)), "n_bytes": F.octet_length(text).cast("bigint")}).select(*[f"`{c}`" for c in kept], name, "n_bytes")
    counted = rows.join(known.withColumnRenamed("digest", name), name, "left")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).drop(name)
