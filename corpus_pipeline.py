"""Corpus pipeline: language, exact copies, near copies, benchmark passages, then pieces of a tokenizer.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``. ``run`` writes each stage's result to the shared checkpoint folder and reads it back for the next,
so a lost executor costs part of one stage."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm import decontaminate, exact_dedup, langid, near_copies, sentencepieces
from drawmark.llm.common import prepared, stored

PIECES = "piece_bpe_32k.model"
# The stages train a network and run a tokenizer library, which SQL cannot express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. It learns from the labels of ``docs`` themselves."""
    prepared(spark)
    return langid.accepted(docs, langid.train_on(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    prepared(spark)
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash within MinHash keys, then checked: five-word shingles, similarity of 0.8 or more): the one with the smallest id."""
    # JVM and workers together came to the memory limit of the check tool, so batches are smaller here
    prepared(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    return near_copies.without_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepared(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, lang, source, piece_ids, n_pieces."""
    # two libraries hold a batch's pieces at once, so batches are smaller here
    prepared(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    coded = sentencepieces.encoded_pieces(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path(PIECES))
    return coded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", clean),
          ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
