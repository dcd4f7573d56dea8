"""Revisits of captures derived from all pages.

Each page gives two full responses some days apart and three revisits of its URL in other spellings, before, between
and after them, with validators that agree, agree weakly, differ or are missing; and a capture of its host's robots
file, a response for some pages and a revisit for most, so a common host is a URL with very many captures."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.queries import query, table
from drawmark.llm.warc_revisit import NOT_MERGED, resolve_revisits

_START = 1704067200  # of the captures, in seconds since 1970
# capture number, kind, seconds after the page's first response
_CAPTURES = ((0, "response", 0), (1, "response", 4 * 86_400), (2, "revisit", -3600), (3, "revisit", 7200), (4, "revisit", 5 * 86_400 + 60), (5, "robots", 0))
_TAG = "'\"' || tag || '-{0}\"'"
_PAGES = "SELECT page_id, url, substr(md5(coalesce(html, '')), 1, 8) AS tag FROM {pages}"
# One text for Spark and SQL; {k} is the capture's number.
_HEADS = {
    0: f"'HTTP/1.1 200 OK{{n}}ETag: ' || {_TAG.format('a')} || '{{n}}Last-Modified: day 1{{n}}Content-Type: text/html{{n}}Cache-Control: max-age=60{{n}}Content-Length: 10'",
    1: f"'HTTP/1.1 200 OK{{n}}etag: ' || {_TAG.format('b')} || '{{n}}Content-Type: text/html{{n}}Last-Modified: day 4{{n}}X-Copy: 1{{n}}X-Copy: 2'",
    2: "'HTTP/1.1 304 Not Modified{n}Last-Modified: day 1'",
    3: f"CASE WHEN page_id % 4 = 0 THEN 'HTTP/1.1 304 Not Modified{{n}}ETag: W/' || {_TAG.format('a')} || '{{n}}Cache-Control: no-cache{{n}}Content-Length: 0{{n}}Expires: soon'"
       " WHEN page_id % 4 = 1 THEN 'HTTP/1.1 304 Not Modified{n}Last-Modified: day 1{n}Connection: x-hop{n}X-Hop: 1{n}Date: today'"
       f" WHEN page_id % 4 = 2 THEN 'HTTP/1.1 304 Not Modified{{n}}ETag: ' || {_TAG.format('c')} ELSE 'HTTP/1.1 304 Not Modified{{n}}Date: today' END",
    4: f"'HTTP/1.1 304 Not Modified{{n}}ETag: ' || {_TAG.format('b')} || '{{n}}X-Copy: 3{{n}}Content-Type: text/plain'",
    5: "CASE WHEN page_id % 40 = 0 THEN 'HTTP/1.1 200 OK{n}ETag: \"r' || CAST(page_id % 400 AS STRING) || '\"{n}Vary: *' ELSE 'HTTP/1.1 304 Not Modified{n}ETag: \"r0\"{n}Vary: accept' END",
}
_ORIGIN = "regexp_extract(url, '^([^/?#]*//[^/?#]*)', 1)"
_URLS = {0: "url", 1: "url", 2: "url || '#again'", 3: f"upper({_ORIGIN}) || substr(url, length({_ORIGIN}) + 1)", 4: "url", 5: f"{_ORIGIN} || '/robots.txt'"}


def _capture(k: int, kind: str, after: int, newline: str) -> dict[str, str]:
    spread = "(page_id * 7919) % 5184000" if k < 5 else "(page_id * 104729) % 864000"
    kind_sql = "CASE WHEN page_id % 40 = 0 THEN 'response' ELSE 'revisit' END" if kind == "robots" else f"'{kind}'"
    return {"record_id": f"page_id * 10 + {k}", "kind": kind_sql, "url": _URLS[k], "seconds": f"{_START} + {spread} + {after}",
            "head": _HEADS[k].replace("{n}", newline)}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*[F.expr(e).alias(n) for n, e in _capture(*c, newline="\\r\\n").items()]) for c in _CAPTURES])
    pages = spark.sql(_PAGES, pages=table(spark, sf_dir, "pages"))
    return pages.select(F.explode(rows).alias("c")).select("c.*").select("record_id", "kind", "url", F.timestamp_seconds("seconds").alias("captured_at"), "head")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SELECTS = " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {n}" for n, e in _capture(*c, newline="' || chr(13) || chr(10) || '").items()) + " FROM tagged" for c in _CAPTURES)
_SQL = f"""
WITH tagged AS ({_PAGES.format(pages="pages")}), captures AS ({_SELECTS}),
cut AS (SELECT *, regexp_replace(url, '(?s)#.*$', '') AS bare FROM captures),
parts AS (SELECT *, {_LOW.format("regexp_extract(bare, '^([^:/?#]*)://', 1)")} AS scheme, {_LOW.format("regexp_extract(bare, '^[^:/?#]*://([^/?]*)', 1)")} AS host,
                 regexp_extract(bare, '^[^:/?#]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '^[^?]*[?](.*)$', 1) AS args FROM cut),
rows AS (SELECT record_id, kind, seconds, head,
  CASE WHEN regexp_matches(bare, '^[^:/?#]*://') THEN scheme || '://'
    || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN args = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(args, '&')), '&') END
  ELSE bare END AS curl,
  list_transform(string_split(head, chr(13) || chr(10))[2:], lambda x: {{'name': {_LOW.format("split_part(x, ':', 1)")}, 'line': x, 'value': trim(substr(x, strpos(x, ':') + 1))}}) AS fields
  FROM parts),
full_ones AS (SELECT curl, seconds, max_by(record_id, record_id) AS refers_to, max_by(fields, record_id) AS old FROM rows WHERE kind = 'response' GROUP BY curl, seconds),
met AS (SELECT r.record_id, r.curl, r.seconds, r.fields, f.refers_to, f.old,
               list_filter(f.old, lambda x: x.name = 'etag')[1].value AS old_tag, list_filter(r.fields, lambda x: x.name = 'etag')[1].value AS new_tag,
               list_filter(f.old, lambda x: x.name = 'last-modified')[1].value AS old_date, list_filter(r.fields, lambda x: x.name = 'last-modified')[1].value AS new_date
        FROM (SELECT * FROM rows WHERE kind = 'revisit') r ASOF LEFT JOIN full_ones f ON r.curl = f.curl AND r.seconds > f.seconds),
judged AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no_earlier_response'
    WHEN old_tag IS NOT NULL AND new_tag IS NOT NULL THEN CASE WHEN regexp_replace(old_tag, '^W/', '') = regexp_replace(new_tag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN old_date IS NOT NULL AND new_date IS NOT NULL THEN CASE WHEN old_date = new_date THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'unverified' END AS outcome,
  list_filter(fields, lambda x: NOT list_contains([{', '.join(f"'{n}'" for n in NOT_MERGED)}], x.name)
              AND NOT list_contains(string_split(coalesce(list_filter(fields, lambda y: y.name = 'connection')[1].value, ''), ','), x.name)) AS allowed FROM met),
merged AS (SELECT *, list_concat(list_filter(old, lambda x: NOT list_contains(list_transform(allowed, lambda y: y.name), x.name)), allowed) AS all_fields FROM judged)
SELECT record_id, curl AS canonical_url, seconds, outcome, refers_to, CASE WHEN outcome = 'resolved' THEN CAST(len(all_fields) AS BIGINT) END AS n_fields,
       CASE WHEN outcome = 'resolved' THEN sha256(array_to_string(list_transform(all_fields, lambda x: x.line), chr(10))) END AS fields_sha256 FROM merged"""


@query("op2_warc_revisit", sql=_SQL.replace("AS STRING", "AS VARCHAR"))
def warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(spark, sf_dir))
    lines = F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["value"]))
    return found.select("record_id", "canonical_url", F.unix_seconds("captured_at").alias("seconds"), "outcome", "refers_to",
                        F.when(F.col("fields").isNotNull(), F.size("fields").cast("bigint")).alias("n_fields"),
                        F.sha2(F.array_join(lines, "\n"), 256).alias("fields_sha256"))
