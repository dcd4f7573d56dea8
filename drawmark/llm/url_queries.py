"""URL filtering over all pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drawmark.llm.queries import query, table
from drawmark.llm.url_filter import RULES_SCHEMA, judge_urls

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_url_filter", sql=f"""
WITH rules(rule, host_part, path_part, verdict) AS (VALUES {', '.join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT p.page_id, p.host, p.path, (SELECT max_by(r, length(r.rule)) FROM rules r
             WHERE (p.host = r.host_part OR ends_with(p.host, '.' || r.host_part)) AND starts_with(p.path, r.path_part)) AS hit FROM parts p)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM judged""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), RULES_SCHEMA)
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")
