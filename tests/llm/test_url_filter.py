"""Verdicts against plain matching; the cascade against set membership."""
import random

import pytest

from drawmark.llm.url_filter import RULES_SCHEMA, build_cascade, is_listed, judge_urls
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, host string, Verdict int, _keys string, _host string, _hit int"


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in rules:
        if rule is None or rule.startswith("/"):
            continue
        cut = rule.find("/") if "/" in rule else len(rule)
        h, p = rule[:cut], rule[cut:]
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(rule), len(h), verdict, rule))
    return host, path, best and best[3], best[2] if best else default


def cases():
    random.seed(2)
    hosts = ["a.com", "www.a.com", "b.a.com", "a.net", "x.y.z.org", "COM", "", ".com", "a..com", "ä.net", "u@a.com:80", "com"]
    paths = ["", "/", "/en/", "/en", "/en/x?y", "/es/1#f", "/fr/#", "?q=/en/", "#/en/", "/en/" + "p" * 3000, "//", "/é/ü"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths]
    return urls + [None, "", "no scheme", "://", "http:/a.com/en/", "x://y://z.com/en/", "http://a.com/\n/en/"]


@pytest.mark.parametrize("limit", [1 << 20, 120])
def test_verdicts(spark, limit):
    rules = [("com/", "allow"), ("a.com/en/", "block"), ("www.a.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("org", "block"),
             ("y.z.org/e", "allow"), ("/x", "block"), (None, "block"), ("net/es/", "block"), ("a.net/en", "allow"), ("a.net/en", "block"), ("ä.net/é", "block")]
    urls = cases() + cases()[:5]
    df = spark.createDataFrame([(i, u, "clash", 1, "k", "h", 2) for i, u in enumerate(urls)], SCHEMA)
    out = judge_urls(df, spark.createDataFrame(rules, RULES_SCHEMA), max_filter_bytes=limit)
    assert sorted(out.columns) == sorted(["page_id", "url", "_keys", "_host", "_hit", "host", "path", "rule", "verdict"])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "", 0, "", "", 0)], SCHEMA)
    none = spark.createDataFrame([], RULES_SCHEMA)
    assert [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in judge_urls(pages, none, default="block").collect()] == [("a.com", "/x", None, "block")]
    one = spark.createDataFrame([("com/", "block")], RULES_SCHEMA)
    assert judge_urls(pages.limit(0), one).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    random.seed(9)
    universe = [f"key{i}" for i in range(4000)]
    listed = set(random.sample(universe, 150)) | {"outside"}
    keys = spark.createDataFrame([(k,) for k in universe + universe[:50]], "key string")
    levels = build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), keys, len(listed), 400)  # a size misjudged: more false positives
    assert len(levels) > 2
    got = {r["key"] for r in keys.filter(is_listed(F.col("key"), levels)).collect()}
    assert got == listed & set(universe)


def test_many_listed_keys(spark):
    """Lists beyond one filter go part by part, without a join."""
    rules = spark.range(200_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com/")).alias("rule"), F.lit("block").alias("verdict"))
    pages = spark.range(300).select("id", F.concat(F.lit("http://www.h"), F.col("id") * 701, F.lit(".com/x")).alias("url"))
    out = judge_urls(pages, rules, default="none", max_filter_bytes=1 << 18)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        n = r["id"] * 701
        assert (r["rule"], r["verdict"]) == ((f"h{n}.com/", "block") if n < 200_000 else (None, "none"))
