"""URL filtering by a cascade of Bloom filters.

The lists hold rules ``host/path``; a rule fits its host, all subdomains and every path that starts with its path.
Each URL asks for all keys that a fitting rule could have (host suffix x path prefix). Which of them are listed is
answered by a cascade: level 0 encodes the listed keys, level 1 the corpus keys that level 0 takes for listed but
are not, level 2 the listed keys that level 1 takes for such, and so on until a level errs on nothing. The level
at which a key is first not found tells whether it is listed, exactly for every key of the corpus and the lists.
Levels are built over the complete key universe of the corpus; applying them is an expression, without a join.

Sizing keeps the first level's false positives about as many as the listed keys, so the whole cascade is a few
tens of bits a listed key, whatever the corpus. Longer lists are cut by the keys' hashes into parts whose cascades take
about ``max_filter_bytes`` each. Every part is a pass over the pages, so neither the driver nor a task holds more than
one part, whatever the lists."""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.llm.common import ascii_lower, bit_of, free_name, stored

MAX_FILTER_BYTES = 1 << 20
RULES_SCHEMA = "rule string, verdict string"


@dataclass(frozen=True)
class Level:
    """Bits of one filter, eight in a byte from the lowest, their number and that of probes."""
    data: bytes
    bits: int
    probes: int


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every rule that could fit, longest first; of equally long ones the one with the longer host first."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.struct(
        (-(F.length(s) + n)).alias("order"), n.alias("n"), F.concat(s, path.substr(F.lit(1), n)).alias("key")))))
    return F.when(host != "", F.transform(F.array_sort(keys), lambda k: k["key"])).otherwise(F.array().cast("array<string>"))


def _probe(key: Column, level: int, bits: int, probes: int) -> list[Column]:
    """Bit positions of a key in a level: double hashing, with hashes of the level's own."""
    first, second = (F.pmod(F.xxhash64(F.lit(2 * level + k), key), F.lit(bits)) for k in (0, 1))
    return [(first + second * i) % bits for i in range(probes)]


def _bit_at(data: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substr(data, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def _in_level(key: Column, index: int, level: Level) -> Column:
    # the filter is bound once, so that the plan has one copy for all probes
    return F.exists(F.array(F.lit(level.data)), lambda data: reduce(
        lambda a, b: a & b, [_bit_at(data, p) for p in _probe(key, index, level.bits, level.probes)]))


def is_listed(key: Column, cascade: list[Level]) -> Column:
    """Whether the cascade holds ``key``: the parity of the first level that does not."""
    out = F.lit(len(cascade) % 2 == 1)
    for i in reversed(range(len(cascade))):
        out = F.when(_in_level(key, i, cascade[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def _fill(keys: DataFrame, index: int, n: int, rate: float) -> Level:
    """The filter of the column ``key``; only its words come to the driver."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    probes = max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
    probes = min(probes, 16)
    at = keys.select(F.explode(F.array(*_probe(F.col("key"), index, bits, probes))).alias("p"))
    rows = (at.groupBy(F.shiftright("p", 6).alias("word"))
            .agg(F.bit_or(bit_of(F.col("p"))).alias("bits")).collect())
    data = bytearray(bits // 8)
    for r in rows:
        data[8 * r["word"]:8 * r["word"] + 8] = r["bits"].to_bytes(8, "little", signed=True)
    return Level(bytes(data), bits, probes)


def predicted_bytes(n_listed: int, n_universe: int) -> int:
    """Size of all levels together."""
    return int(n_listed * (1.5 * math.log2(max(2.0, n_universe / max(1, n_listed))) + 12) / 8) + 64


def build_cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> list[Level]:
    """Cascade of the listed keys over the universe (both with a column ``key``; the universe may repeat keys and
    may hold listed ones). An empty list gives an empty level."""
    rate = min(0.5, max(1e-9, n_listed * math.sqrt(0.5) / max(1, n_universe)))
    levels = [_fill(listed, 0, n_listed, rate)]
    if not n_listed:
        return levels
    # the only pass over the corpus: what level 0 takes for listed, once each, told from the truly listed
    taken = (universe.filter(_in_level(F.col("key"), 0, levels[0])).select("key", F.lit(0).alias("listed"))
             .unionByName(listed.select("key", F.lit(1).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")))
    taken = stored(taken, "url-keys")
    other = 0  # level 1 encodes the unlisted among them, level 2 the listed ones that level 1 holds, ...
    wrong = taken.filter(F.col("listed") == other)
    told = n_listed  # keys that the level before encodes, which this one is asked for
    while (n := wrong.count()) > 0:
        levels.append(_fill(wrong, len(levels), n, min(0.5, max(1e-9, n * math.sqrt(0.5) / told))))
        told = n
        other = 1 - other
        wrong = taken.filter(F.col("listed") == other)
        # of the other kind, those that have not been told apart by an earlier level
        for i in range(1, len(levels)):
            wrong = wrong.filter(_in_level(F.col("key"), i, levels[i]))
    return levels


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
               max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL (existing columns of these names are replaced).

    ``rules``: columns rule (``host/path``) and verdict (allow or block). The longest fitting rule decides, of equally
    long ones that with the longer host; a rule listed with both verdicts blocks. Without a fitting rule the verdict is
    ``default`` and rule is null. Null URLs and URLs without ``://`` have empty host and path and fit no rule. Repeated
    pages are judged alike; rules that are null, repeated or without a host count once or not at all."""
    listed = (rules.filter(F.col("rule").isNotNull() & ~F.startswith("rule", F.lit("/"))).groupBy(F.col("rule").alias("key"))
              .agg(F.max("verdict").alias("verdict")))
    listed = listed.withColumn("path_length", F.length("key") - F.length(F.substring_index("key", "/", 1)))
    sizes = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    path_lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())  # at most the longest path of a rule
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    keys_name, first_name = (free_name(c, [*pages.columns, "host", "path", "rule", "verdict"]) for c in ("_keys", "_first"))
    judged = pages.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not path_lengths:
        return judged
    universe = pages.select(F.explode(_keys(url_host(url), url_path(url), path_lengths)).alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]  # for sizing only
    parts = math.ceil(sum(predicted_bytes(n, n_universe) for n in sizes.values()) / max_filter_bytes)
    if parts > 1:
        listed = stored(listed, "url-lists")

    def of_part(key: Column, part: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)) == part

    def held(key: Column, cascade: list[Level] | None) -> Column:
        return is_listed(key, cascade) if cascade else F.lit(False)

    for part in range(parts):
        here = listed.filter(of_part(F.col("key"), part)) if parts > 1 else listed
        asked = universe.filter(of_part(F.col("key"), part)) if parts > 1 else universe
        if parts > 1:
            sizes = {r["verdict"]: r["n"] for r in here.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        cascades = {v: build_cascade(here.filter(F.col("verdict") == v), asked, n, -(-n_universe // parts)) for v, n in sizes.items()}
        blocked, allowed = cascades.get("block"), cascades.get("allow")
        keyed = judged.withColumn(keys_name, _keys(F.col("host"), F.col("path"), path_lengths))
        mine = (lambda k, part=part: of_part(k, part)) if parts > 1 else (lambda k: F.lit(True))
        fitting = F.filter(F.col(keys_name), lambda k: mine(k) & (held(k, blocked) | held(k, allowed)))
        found = keyed.withColumn(first_name, F.get(fitting, F.lit(0)))
        first, rule, keys = F.col(first_name), F.col("rule"), F.col(keys_name)
        # of an earlier part's rule and this one's, that which comes first among the page's keys
        new = first.isNotNull() & (rule.isNull() | (F.array_position(keys, first) < F.array_position(keys, rule)))
        verdict = F.when(new, F.when(held(first, blocked), F.lit("block")).otherwise(F.lit("allow"))).otherwise(F.col("verdict"))
        judged = found.withColumns({"verdict": verdict, "rule": F.when(new, first).otherwise(rule)}).drop(keys_name, first_name)
        if part < parts - 1:
            judged = stored(judged, "url-judged")
    return judged
