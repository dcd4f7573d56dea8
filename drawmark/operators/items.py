"""Operators on recognised items (text, confidence, box).

Per-page picks are grouped minima of small structs, so every map task sends one row per page and a
page that holds a large share of all items costs no more than any other.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions import readings, text
from drawmark.functions.boxes import Box
from drawmark.settings import RELAXED_NUMBER, SPAN_CODE_AFTER, SPAN_CODE_BEFORE, SPAN_CODE_REST


def first_per(df: DataFrame, keys: list[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` for each key, reduced before the shuffle."""
    ranked = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(k) for k in keep])
    return (df.groupBy(*keys).agg(F.min(ranked).alias("_top"))
            .select(*keys, *[F.col(f"_top.{k}").alias(k) for k in keep]))


def as_spans(items: DataFrame) -> DataFrame:
    """Items as text spans with one box per character (10 px each); every third one runs vertically."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length("text")),
        lambda i: F.struct(F.substring(F.col("text"), i, F.lit(1)).alias("c"),
                           (F.col("x1") + (i - 1) * 10).alias("x0"), F.col("y1").alias("y0"),
                           (F.col("x1") + i * 10).alias("x1"), F.col("y2").alias("y1")))
    return items.select("page_id", "seq", F.when(F.col("seq") % 3 == 0, 0.3).otherwise(1.0).alias("dir_x"),
                        "text", chars.alias("chars"))


def span_codes(spans: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """First code of each horizontal span with the hull of its characters; short codes are dropped."""
    lead = SPAN_CODE_BEFORE + text.prefix_class(prefixes) + SPAN_CODE_AFTER
    code = text.hit(F.col("text"), lead + SPAN_CODE_REST)
    found = (spans.filter(F.abs("dir_x") > 0.5).withColumn("old_text", code)
             .filter(F.length("old_text") >= 7)
             .withColumn("used", F.slice("chars", F.regexp_instr(F.col("text"), F.lit(lead)), F.length("old_text"))))

    def edge(pick, name: str) -> Column:
        return pick(F.transform("used", lambda c: c[name]))

    return found.select("page_id", "seq", "old_text", text.rewritten(F.col("old_text")).alias("new_text"),
                        edge(F.array_min, "x0").alias("x1"), edge(F.array_min, "y0").alias("y1"),
                        edge(F.array_max, "x1").alias("x2"), edge(F.array_max, "y1").alias("y2"))


def distinct_tokens(items: DataFrame, key: str = "page_id") -> DataFrame:
    """Tokens of each page with the place of their first reading."""
    return (items.withColumn("token", text.find_token(F.col("text"))).filter("token IS NOT NULL")
            .groupBy(key, "token").agg(F.min("seq").alias("first_seq")))


def sample_results(pages: DataFrame) -> DataFrame:
    """Recogniser output as parallel arrays, with the field names and gaps that recognisers differ in."""
    n_text = F.col("page_id") % 3 + 1
    n_poly = F.col("page_id") % 4
    texts = F.transform(F.sequence(F.lit(1), n_text.cast("int")),
                        lambda i: F.concat(F.lit("T"), F.col("page_id").cast("string"), F.lit("-"), i.cast("string")))
    polys = F.transform(
        F.when(n_poly > 0, F.sequence(F.lit(1), n_poly.cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)")),
        lambda i: F.array(F.array(i * 10.0, i * 7.0), F.array(i * 10.0 + 5, i * 7.0 + 5)))
    scores = F.transform(F.sequence(F.lit(1), n_text.cast("int")), lambda i: i / 8)
    even = F.col("page_id") % 2 == 0
    return pages.select(
        "page_id",
        F.when(even, polys).alias("dt_polys"), F.when(~even, polys).alias("boxes"),
        F.when(even & (F.col("page_id") % 7 != 0), texts).alias("rec_texts"),
        F.when(~even & (F.col("page_id") % 7 != 0), texts).alias("texts"),
        F.when(F.col("page_id") % 5 != 0, scores).alias("rec_scores"))


def result_rows(results: DataFrame) -> DataFrame:
    """One row per recognised item: shortest of the arrays decides, missing scores count as 1."""
    polys, texts = F.coalesce("dt_polys", "boxes"), F.coalesce("rec_texts", "texts")
    scores = F.coalesce(F.col("rec_scores"), F.transform(texts, lambda t: F.lit(1.0)))
    n = F.least(F.size(polys), F.size(texts), F.size(scores))
    rows = (results.filter(polys.isNotNull() & texts.isNotNull())
            .select("page_id", polys.alias("poly"), texts.alias("text"), scores.alias("conf"), n.alias("n"))
            .select("page_id", F.slice("poly", F.lit(1), F.col("n")).alias("poly"),
                    F.slice("text", F.lit(1), F.col("n")).alias("text"),
                    F.slice("conf", F.lit(1), F.col("n")).alias("conf"))
            .select("page_id", F.posexplode(F.arrays_zip("poly", "text", "conf")).alias("item", "r")))
    return rows.select("page_id", "item", "r.poly", "r.text", "r.conf")


def number_hits(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Items that hold a number once blanks are dropped (or symbols repaired), with the tight box."""
    pattern = text.number_pattern(prefixes)
    read = (items.withColumn("joined", text.no_spaces(F.upper("text")))
            .withColumn("plain", text.first_number(F.col("joined"), prefixes))
            .withColumn("full_text", F.when(F.col("plain").isNotNull(), F.col("joined"))
                        .otherwise(text.backfill_symbols(F.col("joined"), prefixes)))
            .withColumn("number", text.found(F.coalesce("plain", text.first_number(F.col("full_text"), prefixes))))
            .withColumn("start", text.position(F.col("full_text"), pattern)))
    tight = readings.tight_box(Box.corners(), F.col("start"), F.length("number"), F.length("full_text"))
    return (read.withColumn("area", Box.corners().area).withColumn("tight", tight.pack())
            .drop("joined", "plain", "start"))


def tight_numbers(items: DataFrame) -> DataFrame:
    plain = items.filter(text.first_number(text.no_spaces(F.upper("text"))).isNotNull())
    return number_hits(plain).select("page_id", "seq", "number", "tight.*")


def largest_number(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Number with the largest box on each page (the first one wins a tie)."""
    hits = number_hits(items, prefixes).select("page_id", "seq", "number", "area", "tight")
    return first_per(hits, ["page_id"], [-F.col("area"), F.col("seq")], ["number", "area", "tight", "seq"])


def shift_left_edge(columns: DataFrame, items: DataFrame) -> DataFrame:
    """Move a column's left edge past the first item led by a drawing label, where that narrows it."""
    joined = text.no_spaces(F.upper("text"))
    lead = F.when(joined.startswith("DWGNO"), 5).otherwise(3)
    box = Box.corners()
    edge = F.when(F.length(joined) <= lead, box.x2).otherwise((box.x1 + box.w * (lead / F.length(joined))).cast("int"))
    labelled = items.filter(joined.startswith("DWG") & (box.w > 0)).select("page_id", "seq", edge.alias("edge"))
    first = first_per(labelled, ["page_id"], [F.col("seq")], ["edge"])
    moved = (F.col("edge") > F.col("x1")) & (F.col("x2") - F.col("edge") > 0)
    return (columns.join(first, "page_id", "left")
            .select("page_id", F.when(moved, F.col("edge")).otherwise(F.col("x1")).alias("x1"), "y1", "x2", "y2"))


def _joined_reading(items: DataFrame, prefixes: Sequence[str] | None) -> DataFrame:
    """Stages shared by the number searches. Each stage is a column of its own, so that the regular
    expressions are evaluated once per row and the generated code stays small."""
    return (items.withColumn("upper", text.strip(F.upper("text")))
            .withColumn("joined", text.no_spaces(F.col("upper")))
            .withColumn("plain", text.first_number(F.col("upper"), prefixes))
            .withColumn("fixed", text.backfill_symbols(F.col("joined")))
            .withColumn("repaired", text.first_number(F.col("fixed"), prefixes)))


def independent_numbers(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Numbers in items that no drawing label leads: the longer of the plain and the blank-free match,
    else the repaired one."""
    read = (_joined_reading(items.filter(~readings.has_label(text.strip(F.upper("text")))), prefixes)
            .withColumn("tight", text.first_number(F.col("joined"), prefixes)))
    longer = F.when(F.length("tight") >= F.length("plain"), F.col("tight"))
    box = Box.corners()
    return read.select("page_id", "seq", F.coalesce(longer, "plain", "tight", "repaired").alias("number"),
                       ((box.w > 0) & (box.h > box.w * 3)).alias("vertical"), *box.columns()).filter("number IS NOT NULL")


def labelled_numbers(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Numbers after a drawing label, with their character offset in the text and their box."""
    pattern = text.number_pattern(prefixes)
    read = (items.withColumn("skip", readings.label_length(F.col("text"))).filter("skip > 0")
            .withColumn("rest", F.substring(F.upper("text"), F.col("skip") + 1, F.length("text")))
            .withColumn("joined", text.no_spaces(F.col("rest")))
            .withColumn("plain", text.first_number(F.col("joined"), prefixes))
            .withColumn("fixed", text.backfill_symbols(F.col("joined")))
            .withColumn("number", F.coalesce("plain", text.first_number(F.col("fixed"), prefixes)))
            .filter("number IS NOT NULL")
            .withColumn("found_at", text.position(F.when(F.col("plain").isNotNull(), F.col("joined")).otherwise(F.col("fixed")), pattern)))
    # the shortest start of the rest that holds as many non-blank characters
    counted = F.concat(F.lit("^(?: *[^ ]){"), F.col("found_at").cast("string"), F.lit("}"))
    lead = F.call_function("regexp_extract", F.col("rest"), counted, F.lit(0))
    read = read.withColumn("char_offset", (F.col("skip") + F.length(lead)).cast("int"))
    box = readings.cropped_from(Box.corners(), F.col("char_offset"), F.length("text"))
    return read.select("page_id", "seq", "number", "char_offset", *box.columns())


def fallback_numbers(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Strict, else relaxed, else repaired matches; the box starts at the match."""
    pattern = text.number_pattern(prefixes)
    read = (_joined_reading(items, prefixes)
            .withColumn("relaxed", text.hit(F.col("joined"), RELAXED_NUMBER))
            .withColumn("number", F.coalesce("plain", "relaxed", "repaired")).filter("number IS NOT NULL")
            .withColumn("source", F.when(F.col("plain").isNotNull(), F.col("upper"))
                        .when(F.col("relaxed").isNotNull(), F.col("joined")).otherwise(F.col("fixed")))
            .withColumn("start", F.when(F.col("plain").isNull() & F.col("relaxed").isNotNull(),
                                        text.position(F.col("source"), RELAXED_NUMBER))
                        .otherwise(text.position(F.col("source"), pattern))))
    box = Box.corners()
    crop = readings.cropped_from(box, F.col("start"), F.length("source"))
    use = (F.col("start") > 0) & (box.w > 0)
    pairs = zip(crop.columns(), box.columns(), ("x1", "y1", "x2", "y2"))
    return read.select("page_id", "seq", "number", *[F.when(use, a).otherwise(b).cast("int").alias(n) for a, b, n in pairs])


def first_independent(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """First item of a page that is a number by itself."""
    return first_per(independent_numbers(items, prefixes), ["page_id"], [F.col("seq")],
                     ["number", "seq", "vertical", "x1", "y1", "x2", "y2"])


def first_labelled(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """First item of a page whose number follows a drawing label."""
    return first_per(labelled_numbers(items, prefixes), ["page_id"], [F.col("seq")],
                     ["number", "seq", "x1", "y1", "x2", "y2"])


def first_fallback(items: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """First item of a page that matches strictly, loosely or after repair."""
    return first_per(fallback_numbers(items, prefixes), ["page_id"], [F.col("seq")],
                     ["number", "seq", "x1", "y1", "x2", "y2"])


def first_label_estimate(items: DataFrame) -> DataFrame:
    """Estimated number box right of the first bare label of a page."""
    box = readings.estimated_number_box(F.col("text"), Box.corners())
    found = (items.filter(readings.label_length(F.col("text")) > 0).select("page_id", "seq", *box.columns()))
    return first_per(found, ["page_id"], [F.col("seq")], ["seq", "x1", "y1", "x2", "y2"])


def ranked_numbers(items: DataFrame, outside: Column, prefixes: Sequence[str] | None = None) -> DataFrame:
    """First number of each page by the best search that finds one: page_id, strategy, number, corners.

    1: independent text, 2: after a label, 3: any match, 4: estimated from a label (without a number); 1 and 3 only look
    at items for which ``outside`` holds. All four are read off an item in one pass and one minimum a page decides."""
    corners = ("x1", "y1", "x2", "y2")
    box, pattern = Box.corners(), text.number_pattern(prefixes)
    read = (_joined_reading(items.withColumn("out", outside), prefixes)
            .withColumn("blank_free", text.first_number(F.col("joined"), prefixes))
            .withColumn("relaxed", text.hit(F.col("joined"), RELAXED_NUMBER))
            .withColumn("skip", readings.label_length(F.col("text")))
            .withColumn("rest", F.when(F.col("skip") > 0, F.substring(F.upper("text"), F.col("skip") + 1, F.length("text"))))
            .withColumn("after", text.no_spaces(F.col("rest")))
            .withColumn("after_plain", text.first_number(F.col("after"), prefixes))
            .withColumn("after_fixed", text.backfill_symbols(F.col("after")))
            .withColumn("after_number", F.coalesce("after_plain", text.first_number(F.col("after_fixed"), prefixes))))
    longer = F.when(F.length("blank_free") >= F.length("plain"), F.col("blank_free"))
    alone = F.when(F.col("out") & ~readings.has_label(F.col("upper")), F.coalesce(longer, "plain", "blank_free", "repaired"))
    found_at = text.position(F.when(F.col("after_plain").isNotNull(), F.col("after")).otherwise(F.col("after_fixed")), pattern)
    read = read.withColumn("alone", alone).withColumn("found_at", F.when(F.col("after_number").isNotNull(), found_at))
    counted = F.concat(F.lit("^(?: *[^ ]){"), F.col("found_at").cast("string"), F.lit("}"))
    read = read.withColumn("offset", F.when(F.col("found_at").isNotNull(), (F.col("skip") + F.length(F.call_function("regexp_extract", F.col("rest"), counted, F.lit(0)))).cast("int")))
    loose = F.when(F.col("out"), F.coalesce("plain", "relaxed", "repaired"))
    by_relaxed = F.col("plain").isNull() & F.col("relaxed").isNotNull()
    source = F.when(F.col("plain").isNotNull(), F.col("upper")).when(F.col("relaxed").isNotNull(), F.col("joined")).otherwise(F.col("fixed"))
    read = (read.withColumn("loose", loose).withColumn("source", source)
            .withColumn("start", F.when(by_relaxed, text.position(F.col("source"), RELAXED_NUMBER)).otherwise(text.position(F.col("source"), pattern))))
    crop = readings.cropped_from(box, F.col("start"), F.length("source"))
    use = (F.col("start") > 0) & (box.w > 0)
    loose_box = [F.when(use, a).otherwise(b).cast("int") for a, b in zip(crop.columns(), box.columns())]

    def candidate(strategy: int, number: Column, columns: list[Column], when: Column) -> Column:
        return F.when(when, F.struct(F.lit(strategy).alias("strategy"), F.col("seq").alias("seq"), number.alias("number"),
                                     *[c.cast("int").alias(n) for c, n in zip(columns, corners)]))

    none = F.lit(None).cast("string")
    choices = F.coalesce(
        candidate(1, F.col("alone"), box.columns(), F.col("alone").isNotNull()),
        candidate(2, F.col("after_number"), readings.cropped_from(box, F.col("offset"), F.length("text")).columns(), F.col("after_number").isNotNull()),
        candidate(3, F.col("loose"), loose_box, F.col("loose").isNotNull()),
        candidate(4, none, readings.estimated_number_box(F.col("text"), box).columns(), F.col("skip") > 0))
    # a filter before the aggregate would move below the steps above and repeat all of their expressions
    best = read.select("page_id", choices.alias("c")).groupBy("page_id").agg(F.min("c").alias("c")).filter("c IS NOT NULL")
    return best.select("page_id", "c.strategy", "c.number", *[f"c.{n}" for n in corners])
