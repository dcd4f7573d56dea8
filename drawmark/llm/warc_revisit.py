"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit says that the server answered 304. It is resolved by an as-of join: of the full responses (status 200) of
the same canonical URL, the latest one captured strictly earlier. Its validators are then checked against those that
the 304 carries, and the header fields that a 304 may update are merged into the response's.

The as-of join neither pairs rows nor gathers a URL's captures in one task: revisits ask once for each distinct
(URL, time); within a (URL, day) a window carries the last response forward, and the last response of each day is
carried to the following days. A day has at most 86,400 capture times (archive dates have seconds), a URL as many rows
in the second step as it has days, so a URL with a third of all captures is many bounded groups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawmark.llm.common import ascii_lower, stored

# Fields that a 304 must not change in a stored response, and fields of one connection.
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive",
              "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade")
RESOLVED, NONE_EARLIER, MISMATCH, UNVERIFIED = "resolved", "no_earlier_response", "validator_mismatch", "unverified"
_FIELDS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased (A-Z), default port and fragment removed, an empty path as ``/``, query arguments
    sorted, an empty query dropped. Without ``://`` only the fragment goes; null stays null."""
    bare = F.substring_index(url, "#", 1)
    lead = F.substring_index(bare, ":", 1)
    is_web = (F.instr(bare, ":") > 0) & (F.instr(bare, "://") == F.instr(bare, ":")) & (F.instr(lead, "/") == 0) & (F.instr(lead, "?") == 0)
    scheme, rest = ascii_lower(lead), F.substring(bare, F.instr(bare, "://") + 3, F.length(bare))
    before = F.substring_index(rest, "?", 1)
    host = ascii_lower(F.substring_index(before, "/", 1))
    port = F.when((scheme == "http") & host.endswith(":80"), 3).when((scheme == "https") & host.endswith(":443"), 4).otherwise(0)
    path = F.substring(before, F.length(F.substring_index(before, "/", 1)) + 1, F.length(before))
    arguments = F.substring(rest, F.length(before) + 2, F.length(rest))
    query = F.when(arguments == "", "").when(F.instr(arguments, "&") == 0, F.concat(F.lit("?"), arguments)).otherwise(
        F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(arguments, "&")), "&")))
    return F.when(is_web, F.concat(scheme, F.lit("://"), F.substring(host, F.lit(1), F.length(host) - port), F.when(path == "", "/").otherwise(path), query)).otherwise(bare)


def status_of(head: Column) -> Column:
    """Status code of an HTTP head; null if there is none."""
    return F.regexp_extract(head, r"^HTTP/\S+ +(\d{3})", 1).try_cast("int")


def fields_of(head: Column) -> Column:
    """Header fields (name, value) of an HTTP head in order; lines without a name are left out, null has none."""
    lines = F.split(F.coalesce(head, F.lit("")), "\r?\n")
    cut = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.struct(
        F.when(F.instr(x, ":") > 0, F.rtrim(F.substring_index(x, ":", 1), F.lit(" \t"))).otherwise("").alias("name"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.filter(cut, lambda f: (f["name"] != "") & (F.translate(f["name"], " \t\u000b\f", "") == f["name"]))


def field_value(fields: Column, name: str) -> Column:
    """First value of a field, its name in any case; null if missing or empty."""
    found = F.get(F.filter(fields, lambda f: ascii_lower(f["name"]) == name), F.lit(0))["value"]
    return F.when(found != "", found)


def merged_fields(stored: Column, update: Column) -> Column:
    """Fields of a stored response after a 304: permitted fields of the 304 replace those of the same name and follow the rest."""
    listed = F.split(ascii_lower(F.coalesce(field_value(update, "connection"), F.lit(""))), "[ \t]*,[ \t]*")
    allowed = F.filter(update, lambda f: ~F.array_contains(F.concat(F.array(*map(F.lit, NOT_MERGED)), listed), ascii_lower(f["name"])))
    names = F.transform(allowed, lambda f: ascii_lower(f["name"]))
    return F.concat(F.filter(stored, lambda f: ~F.array_contains(names, ascii_lower(f["name"]))), allowed)


def _opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def latest_earlier(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """For each distinct (url, at) of ``asked``: ``response``, that of the latest row of ``responses`` (url, at, response)
    with the same url and an earlier at; null if there is none. Of several at one time the largest response counts. Times
    of responses come along."""
    day = F.floor(F.unix_micros("at") / 86_400_000_000).alias("day")
    points = (responses.select("url", "at", "response").unionByName(asked.select("url", "at"), allowMissingColumns=True)
              .filter("url IS NOT NULL AND at IS NOT NULL").groupBy("url", "at").agg(F.max("response").alias("response")).select("url", "at", "response", day))
    points = stored(points, "points")  # narrow, and read three times
    before = Window.partitionBy("url", "day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = points.withColumn("earlier", F.last("response", ignorenulls=True).over(before))
    days = points.filter("response IS NOT NULL").groupBy("url", "day").agg(F.max_by("response", "at").alias("response"))
    asked_days = points.select("url", "day").unionByName(days.select("url", "day", "response"), allowMissingColumns=True)
    by_day = asked_days.groupBy("url", "day").agg(F.max("response").alias("response"))
    carried = by_day.select("url", "day", F.last("response", ignorenulls=True).over(
        Window.partitionBy("url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("before_day"))
    return within.join(carried, ["url", "day"]).select("url", "at", F.coalesce("earlier", "before_day").alias("response"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, canonical_url, captured_at, outcome, refers_to (id of the latest
    earlier full response, whatever the outcome), fields (merged; null unless resolved).

    ``records``: record_id, kind (``response`` or ``revisit``), url, captured_at, head (the HTTP head); more columns do not
    matter. Revisits count with status 304 or without a status, responses with status 200. Outcomes: ``resolved`` if the
    entity tags (weak comparison), or failing those the Last-Modified values, of both are equal; ``validator_mismatch``
    if they differ; ``unverified`` if the two share no validator; ``no_earlier_response``, also for a null URL or time.
    Repeated revisits are resolved each; repeated responses count once. No rows give none."""
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), F.col("captured_at").alias("at"), "head")
    status = status_of(F.col("head"))
    full = rows.filter((F.col("kind") == "response") & (status == 200))
    revisits = rows.filter((F.col("kind") == "revisit") & (F.coalesce(status, F.lit(304)) == 304))
    # ids alone go through the search; heads meet once, by id, and are parsed after that
    found = latest_earlier(full.select("url", "at", F.col("record_id").alias("response")), revisits.select("url", "at"))
    # stored, so that a response that very many revisits refer to is split in the join
    heads = stored(full.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("head").alias("old_head")), "heads")
    met = (revisits.select("record_id", "url", "at", "head").join(found.withColumnRenamed("response", "refers_to"), ["url", "at"], "left")
           .join(heads, "refers_to", "left").withColumn("old", fields_of(F.col("old_head"))).withColumn("new", fields_of(F.col("head"))))
    old, new = F.col("old"), F.col("new")
    tags = [_opaque(field_value(f, "etag")) for f in (old, new)]
    dates = [field_value(f, "last-modified") for f in (old, new)]
    outcome = (F.when(F.col("refers_to").isNull(), NONE_EARLIER)
               .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], RESOLVED).otherwise(MISMATCH))
               .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], RESOLVED).otherwise(MISMATCH))
               .otherwise(UNVERIFIED))
    return (met.withColumn("outcome", outcome)
            .select("record_id", F.col("url").alias("canonical_url"), F.col("at").alias("captured_at"), "outcome", "refers_to",
                    F.when(F.col("outcome") == RESOLVED, merged_fields(old, new)).otherwise(F.lit(None).cast(_FIELDS)).alias("fields")))
