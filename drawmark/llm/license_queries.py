"""License scans of all documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.license_rules import RULES
from drawmark.llm.license_scan import CONFIDENCE, GAP, license_scan, spaced
from drawmark.llm.queries import query, table

_RULES = ", ".join(f"({r.number}, {r.base}, {r.priority}, '{r.label}', ' {spaced(r.keyword)}', ' ({spaced(r.pattern)}) ')" for r in RULES)


@query("op12_license_scan", sql=f"""
WITH rules(rule, base, priority, label, keyword, pattern) AS (VALUES {_RULES}),
d AS (SELECT doc_id, row_number() OVER () AS n, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '{GAP}+', '  ', 'g'), ' ') || ' ' AS t FROM documents),
marked AS (SELECT n, rules.*, string_split(trim(regexp_replace(t, pattern, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), '  ') AS w
           FROM d JOIN rules ON contains(t, keyword)),
places AS (SELECT n, rule, base, priority, label, list_filter(range(len(w)), lambda i: starts_with(w[i + 1], chr(1))) AS firsts,
                  list_filter(range(len(w)), lambda i: ends_with(w[i + 1], chr(2))) AS lasts FROM marked),
hits AS (SELECT n, rule, base, priority, label, unnest(firsts) AS first, unnest(lasts) AS last FROM places WHERE len(firsts) > 0),
kept AS (SELECT * FROM hits h WHERE base OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.n = h.n AND o.first <= h.first AND o.last >= h.last
           AND (o.priority > h.priority OR o.priority = h.priority AND (o.last - o.first > h.last - h.first OR o.last - o.first = h.last - h.first AND o.rule < h.rule)))),
bases AS (SELECT n, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
          FROM hits WHERE base GROUP BY n),
sums AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list_extract({list(CONFIDENCE)}, max(priority) + 1) AS score FROM kept GROUP BY n)
SELECT doc_id, CASE WHEN t = '  ' THEN 0 ELSE CAST(len(string_split(trim(t, ' '), '  ')) AS BIGINT) END AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN bases USING (n) LEFT JOIN sums USING (n)""")
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bases = F.filter("detections", lambda d: d["base"])
    firsts = F.transform("bases", lambda d: d["first"].cast("bigint"))
    return found.select("doc_id", "n_words", bases.alias("bases"), "labels", "score").select(
        "doc_id", "n_words", F.size("bases").cast("bigint").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("bases", lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
