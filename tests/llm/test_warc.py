"""Resolution against a plain search over all captures."""
import random
from datetime import datetime, timedelta, timezone

from drawmark.llm.warc_revisit import NOT_MERGED, canonical_url, fields_of, resolve_revisits

SCHEMA = "record_id bigint, kind string, url string, captured_at timestamp, head string, day int, response string, at int"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def head(status, fields):
    return f"HTTP/1.1 {status} X\r\n" + "\r\n".join(f"{a}: {b}" for a, b in fields)


def value(fields, name):
    return next((b for a, b in fields if a.lower() == name), None) or None


def plain(rows):
    out = []
    for r in rows:
        if r["kind"] != "revisit" or r["status"] not in (304, None):
            continue
        earlier = [x for x in rows if x["kind"] == "response" and x["status"] == 200 and None not in (x["url"], x["at"], r["url"], r["at"])
                   and x["url"] == r["url"] and x["at"] < r["at"]]
        if not earlier:
            out.append((r["id"], "no_earlier_response", None, None))
            continue
        best = max(earlier, key=lambda x: (x["at"], x["id"]))
        tags = [value(f["fields"], "etag") for f in (best, r)]
        dates = [value(f["fields"], "last-modified") for f in (best, r)]
        if None not in tags:
            outcome = "resolved" if tags[0].removeprefix("W/") == tags[1].removeprefix("W/") else "validator_mismatch"
        elif None not in dates:
            outcome = "resolved" if dates[0] == dates[1] else "validator_mismatch"
        else:
            outcome = "unverified"
        hop = [h.strip() for h in (value(r["fields"], "connection") or "").lower().split(",")]
        new = [(a, b) for a, b in r["fields"] if a.lower() not in NOT_MERGED and a.lower() not in hop]
        merged = [(a, b) for a, b in best["fields"] if a.lower() not in {n.lower() for n, _ in new}] + new
        out.append((r["id"], outcome, best["id"], merged if outcome == "resolved" else None))
    return out


def test_resolution(spark):
    random.seed(4)
    names = ["ETag", "etag", "Last-Modified", "Content-Length", "X-A", "x-a", "Connection", "Cache-Control"]
    values = ["1", "W/1", "2", "", "x-a", "no cache, max-age=3"]
    rows = []
    for i in range(600):
        kind = random.choice(["response", "revisit", "revisit", "request"])
        rows.append({"id": i, "kind": kind, "url": random.choice(["http://a/", "http://b/x", "http://c/", "http://c/", None]),
                     "at": None if random.random() < 0.02 else START + timedelta(days=random.choice([0, 0, 1, 2, 30]), seconds=random.randint(0, 40)),
                     "status": random.choice([200, 200, 404] if kind == "response" else [304, 304, 200, None]),
                     "fields": [(random.choice(names), random.choice(values)) for _ in range(random.randint(0, 5))]})
    rows.append(dict(rows[0]))  # a repeated row
    df = spark.createDataFrame([(r["id"], r["kind"], r["url"], r["at"], None if r["status"] is None and not r["fields"] else
                                 head(r["status"], r["fields"]) if r["status"] else "?\r\n" + head(0, r["fields"]).split("\r\n", 1)[1], 1, "clash", 2) for r in rows], SCHEMA)
    got = sorted((r["record_id"], r["outcome"], r["refers_to"], None if r["fields"] is None else [tuple(f) for f in r["fields"]]) for r in resolve_revisits(df).collect())
    assert got == sorted(plain(rows))
    assert {o for _, o, *_ in got} == {"resolved", "no_earlier_response", "validator_mismatch", "unverified"}
    assert resolve_revisits(df.limit(0)).collect() == []


def test_parts(spark):
    urls = {"HTTP://User@Ex.COM:80/A?b=2&a=1#f": "http://user@ex.com/A?a=1&b=2", "https://x.org": "https://x.org/", "https://x.org:443?": "https://x.org/",
            "http://x.org:443/é#": "http://x.org:443/é", "urn:Thing#x": "urn:Thing", "": "", None: None, "http://x/a?q=http://y/#z": "http://x/a?q=http://y/"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(canonical_url(df.u)).collect()] == list(urls.values())
    heads = spark.createDataFrame([("HTTP/1.1 200 OK\r\nA:  b : c \nbad line\n: none\nEmpty:\r\n\r\nbody",), (None,), ("",)], "h string")
    got = [[tuple(f) for f in r[0]] for r in heads.select(fields_of(heads.h)).collect()]
    assert got == [[("A", "b : c"), ("Empty", "")], [], []]
