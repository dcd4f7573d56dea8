"""Token counts and token files of all documents."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drawmark.llm.common import scratch_path
from drawmark.llm.huffman import read_checksums, write_ids
from drawmark.llm.queries import query, table
from drawmark.llm.token_cache import token_counts


@query("op5_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of this run's own: every run encodes what it counts
    cache = scratch_path(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache).drop("text")


@query("op7_token_files")
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_checksums(spark, out)
