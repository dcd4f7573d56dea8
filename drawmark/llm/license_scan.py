"""License scans by ordered signature rules.

A text is normalised to words (A-Z lower-cased, everything else that is ASCII and no letter or digit is a gap). A first
expression tests whether any rule's keyword stands in it; texts without one are done. The others try the patterns of those
rules whose keywords they hold. A match is an interval of words, and of overlapping ones only some count: an interval
that lies inside one of a rule with a higher priority is suppressed, at equal priority the longer one stays, of equal
intervals the earlier rule. Priorities and containment are transitive, so what is suppressed does not depend on an order.

All of it is built-in expressions on the row itself: nothing is shuffled, and a text's cost grows with its words times the
rules that match in it. In the normalised form every word has a space on both sides, so a pattern can ask for whole
words, neighbouring matches do not share a space, and spaces count words."""
from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions.text import bind
from drawmark.llm.common import ascii_lower, free_name
from drawmark.llm.license_rules import RULES, Rule

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = GAP.replace("[", "[^", 1) + "+"
# Confidence of a detection by its rule's priority.
CONFIDENCE = (0.2, 0.5, 0.7, 0.9, 1.0)
SCAN_COLUMNS = ("n_words", "detections", "labels", "score")
_RULE = "array<struct<number:int,base:boolean,priority:int,label:string,keyword:string,pattern:string>>"
_DETECTIONS = "array<struct<first:int,last:int,rule:int,base:boolean,priority:int,label:string,kept:boolean>>"


def spaced(pattern: str) -> str:
    """A keyword or pattern for the normalised form: two spaces between words."""
    return pattern.replace(" ", "  ")


def gate_pattern(rules: Sequence[Rule]) -> str:
    """Expression over raw texts that holds wherever a keyword of ``rules`` stands."""
    keywords = sorted({r.keyword for r in rules})
    # a keyword that begins with another one adds nothing
    least = [k for k in keywords if not any(k != o and k.startswith(o) for o in keywords)]
    return f"(?:^|{GAP})(?i:{'|'.join(f'{GAP}+'.join(map(re.escape, k.split())) for k in least)})"


def normalised(text: Column) -> Column:
    """The words of a text, each with a space before and after it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), f"{GAP}+", "  ")), F.lit(" "))


def _places(text: Column, rule: Column) -> Column:
    """Intervals of words (first, last) at which a rule's pattern stands."""
    marked = F.regexp_replace(text, F.concat(F.lit(" ("), rule["pattern"], F.lit(") ")), F.lit(" \x01$1\x02 "))
    words = F.split(F.substring(marked, 2, 1 << 30), "  ")

    def intervals(words: Column) -> Column:
        firsts = F.array_compact(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)))
        # the last word has one space after it
        lasts = F.array_compact(F.transform(words, lambda w, i: F.when(F.endswith(F.rtrim(w), F.lit("\x02")), i)))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(
            a.alias("first"), (-b).alias("before"), (-rule["priority"]).alias("below"), rule["number"].alias("rule"), rule["base"].alias("base"), rule["label"].alias("label")))
    return bind(words, intervals)


def _running_maxima(values: Column) -> Column:
    """The maximum of all values up to each, by doubling."""
    rounds = F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), values, lambda v, k: F.transform(
        v, lambda x, i: F.greatest(x, F.coalesce(F.get(v, i - F.call_function("shiftleft", F.lit(1), k)), x))))


def _detections(text: Column, rules: Sequence[Rule]) -> Column:
    table = F.from_json(F.lit(json.dumps([{**r._asdict(), "keyword": " " + spaced(r.keyword), "pattern": spaced(r.pattern)} for r in rules])), _RULE)

    def found(words: Column) -> Column:
        tried = F.filter(table, lambda r: F.contains(words, r["keyword"]))
        return F.array_sort(F.flatten(F.transform(tried, lambda r: _places(words, r))))

    def judged(hits: Column) -> Column:
        # sorted by first word, later last words first, higher priorities first: whatever contains a hit stands before it
        levels = F.transform(F.sequence(F.lit(0), F.lit(len(CONFIDENCE) - 1)), lambda level: _running_maxima(
            F.transform(hits, lambda h: F.when(-h["below"] >= level, -h["before"]).otherwise(-1))))
        return bind(levels, lambda levels: F.transform(hits, lambda h, i: F.struct(
            h["first"].alias("first"), (-h["before"]).alias("last"), h["rule"].alias("rule"), h["base"].alias("base"), (-h["below"]).alias("priority"),
            h["label"].alias("label"), (h["base"] | (F.coalesce(F.get(F.get(levels, -h["below"]), i - 1), F.lit(-1)) < -h["before"])).alias("kept"))))
    return bind(bind(normalised(text), found), judged)


def license_scan(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """``docs`` with n_words, detections (first and last word, rule, base, priority, label, kept; by first word), labels
    (distinct, of the kept detections, sorted) and score (the confidence of the surest kept one, 0 without any);
    existing columns of these names are replaced.

    A suppressed detection is listed with kept = false; base rules are always kept. Null and empty texts have no words
    and no detections. Equal intervals count for the earlier rule. Repeated rows each give a row, an empty table gives
    none. Texts of any length are scanned whole."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plain = docs.drop(*[c for c in docs.columns if c.lower() in SCAN_COLUMNS and c != text_col])
    found = F.when(F.rlike(text, F.lit(gate_pattern(rules))), _detections(text, rules)).otherwise(F.array()).cast(_DETECTIONS)

    def summed(hits: Column) -> Column:
        kept = F.filter(hits, lambda d: d["kept"])
        surest = F.get(F.array(*map(F.lit, CONFIDENCE)), F.array_max(F.transform(kept, lambda d: d["priority"])))
        return F.struct(hits.alias("detections"), F.array_sort(F.array_distinct(F.transform(kept, lambda d: d["label"]))).alias("labels"),
                        F.coalesce(surest, F.lit(0.0)).alias("score"))
    name = free_name("_scan", plain.columns)
    scanned = plain.withColumn(name, F.struct(F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"), bind(found, summed).alias("scan")))
    return scanned.select(*[f"`{c}`" for c in plain.columns], f"{name}.n_words", f"{name}.scan.*")
