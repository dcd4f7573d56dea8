"""Periodic runs of all documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.functions.text import bind
from drawmark.llm.periodic_runs import periodic_runs
from drawmark.llm.queries import CRC_SQL, query, table


def planted(doc_id: Column, text: Column) -> Column:
    """The text of every document, made periodic from one word on for those whose hash the contract names."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = (g % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        copies = F.ceil((n - start) / period).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), copies)), 1, n - start)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, start), tail), " "))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, bind(words, repeated)).otherwise(text)


@query("op11_periodic_runs", sql=f"""
WITH {CRC_SQL},
given AS (SELECT d.doc_id, c.crc % 10 = 0 AS planted, c.crc // 10 AS g, regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+') AS w
          FROM documents d JOIN (SELECT DISTINCT doc_id, crc FROM crcs) c USING (doc_id)),
cuts AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a FROM given),
d AS (SELECT doc_id, n, CASE WHEN planted AND n > 0
                             THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM cuts),
-- sequences of six words that occur again: at the distance of a run's period, one after the other
sixes AS (SELECT doc_id, i, hash(list_slice(w, i + 1, i + 6)) AS key, list_slice(w, i + 1, i + 6) AS six FROM d, unnest(range(n - 5)) AS r(i) WHERE n >= 12),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
          FROM sixes x JOIN sixes y ON x.doc_id = y.doc_id AND x.key = y.key AND x.i < y.i WHERE x.six = y.six),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM pairs GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT d.doc_id, coalesce(string_agg(w[i + 1], ' ' ORDER BY i), '') AS text
         FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM d) d LEFT JOIN dropped USING (doc_id, i) WHERE dropped.doc_id IS NULL GROUP BY d.doc_id),
sums AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length,
                first(period ORDER BY length DESC, start, period) AS period,
                sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # the greatest of (length, -start, -period)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.shorter")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.shorter")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
