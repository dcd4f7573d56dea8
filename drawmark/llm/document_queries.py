"""Operators over all documents."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.exact_dedup import marked_duplicates
from drawmark.llm.langid import held_out, languages_of, train_on
from drawmark.llm.decontaminate import benchmark_hits
from drawmark.llm.queries import query, table
from drawmark.llm.sentencepieces import decoded_pieces, encoded_pieces
from drawmark.llm.simhash import near_duplicates


@query("op3_exact_dedup", sql="""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@query("op8_decontamination", sql=f"""
WITH items AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(list_slice(w, i, i + least(n, 10) - 1), ' ') AS win
            FROM (SELECT item_id, w, n, unnest(generate_series(1, greatest(n - 9, 1))) AS i FROM items)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
          FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, g.size AS size, item_id FROM grams g JOIN windows USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
          FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decoded_pieces(encoded_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_xxh64"), "parity",
                        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train_on(docs)
    return languages_of(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
