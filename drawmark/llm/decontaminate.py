"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words of a-z, 0-9 and non-ASCII characters, A-Z lower-cased. Each benchmark item gives its
windows of ``WINDOW`` consecutive words (an item with fewer words is one window). All windows form one automaton, which
reads each document once, whatever the number of windows; what it finds is mapped back to words and to characters of
the original text.

The automaton works on the UTF-8 bytes read as Latin-1, with single spaces between and around words, so a match is
always made of whole words. Windows are dealt into parts of about ``PART_BYTES`` by their hash. A benchmark of one part, as is
usual, is one automaton, built once per worker, and one pass over the documents. A larger one takes a pass for each part;
each pass keeps what it finds by the text's digest, and the last one puts the finds of a text together. Driver and workers
hold one part at a time, whatever the size of the benchmark."""
from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.llm.common import bit_at, bit_words, free_name, give_back, held, stored

WINDOW = 10
PART_BYTES = 4 << 20  # an automaton takes some 45 times as much memory
HIT_COLUMNS = ("n_words", "n_hit", "items", "spans")
HITS = "n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<begin:int,end:int>>"

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7a else c + 32 if 0x41 <= c <= 0x5a else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Distinct windows of an item in order of appearance, their words joined by single spaces."""
    words = words_of(text)
    n = min(size, len(words))
    return list(dict.fromkeys(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))) if n else []


class Automaton:
    """Finds all occurrences of window texts in a text; windows are (text, ids of the items that have it)."""

    def __init__(self, windows: list[tuple[bytes, list[int]]]):
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.items, self.sizes = [ids for _, ids in windows], [w.count(b" ") + 1 for w, _ in windows]
        for k, (window, _) in enumerate(windows):
            self.found.add_word(f" {window.decode('latin-1')} ", k)
        if windows:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of words that are a window (first, one past the last) and the ids of the items found."""
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.items or not words:
            return runs, items
        padded = f" {b' '.join(words).decode('latin-1')} "
        spaces = None
        for end, k in self.found.iter(padded):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), dtype=np.uint8) == 0x20)
            after = int(np.searchsorted(spaces, end))
            runs.append((after - self.sizes[k], after))
            items.update(i for i in self.items[k] if i is not None)
        return runs, items


def _marked(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Of n words, those in any run."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for a, b in runs:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps[:-1]) > 0


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the original text, each from the first to the last word of a run of hit words."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]


_GAP_FREE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FILTER_BITS = 1 << 22


def window_parts(benchmark: DataFrame, id_col: str, text_col: str, size: int, part_bytes: int) -> tuple[DataFrame, int]:
    """All distinct windows (w, ids of their items, part), stored, and the number of parts."""
    @F.pandas_udf("array<binary>")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: item_windows(t, size))
    rows = stored(benchmark.select(F.col(f"`{id_col}`").alias("id"), F.explode(windows(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("w"))
                  .groupBy("w").agg(F.collect_set("id").alias("ids")), "windows")
    total = rows.agg(F.sum(F.length("w") + 8 * F.size("ids"))).first()[0] or 0
    n_parts = max(1, -(-int(total) // part_bytes))
    return rows.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(n_parts))), n_parts


def _sent(windows: DataFrame, part: int) -> tuple:
    """One part of the windows, sent to the workers, and the key of its automaton."""
    rows = [(bytes(r["w"]), list(r["ids"])) for r in windows.filter(F.col("part") == part).select("w", "ids").collect()]
    return windows.sparkSession.sparkContext.broadcast(rows), ("automaton", uuid.uuid4().hex)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of a window), items (ids, ascending) and spans of the
    original text (begin, end in code points, end excluded); existing columns of these names are replaced.

    Null and empty texts have no words. Items without words have no window; the words of an item with a null id count
    as hit, but the id is not listed. Repeated items count once, repeated documents each give a row. With an empty
    benchmark nothing is hit. Texts of any length are scanned whole."""
    windows, n_parts = window_parts(benchmark, item_col, item_text_col, size, part_bytes)
    plain = docs.drop(*[c for c in docs.columns if c.lower() in HIT_COLUMNS and c not in (id_col, text_col)])
    text, name = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), free_name("_hits", plain.columns)
    shown = [f"`{c}`" for c in plain.columns]
    if n_parts > 1:
        return _hits_by_parts(plain, text, name, windows, n_parts).select(*shown, f"{name}.*")
    sent, key = _sent(windows, 0)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        automaton, out = held(key, lambda: Automaton(sent.value)), []
        for t in texts:
            words = words_of(t)
            runs, items = automaton.scan(words)
            out.append(_summed(t, len(words), runs, sorted(items)))
        give_back()
        return pd.DataFrame(out, columns=list(HIT_COLUMNS))
    return plain.withColumn(name, hits(text)).select(*shown, f"{name}.*")


def _summed(text: str, n_words: int, runs: list[tuple[int, int]], items: list[int]) -> tuple:
    if not runs:
        return n_words, 0, [], []
    hit = _marked(n_words, runs)
    return n_words, int(hit.sum()), items, [{"begin": a, "end": b} for a, b in _spans(text, hit)]


def _part_hits(texts: DataFrame, windows: DataFrame, part: int) -> DataFrame:
    """Finds of one part (sha, runs, items), one row for each distinct text that has any, stored."""
    sent, key = _sent(windows, part)

    @F.pandas_udf("runs array<struct<a:int,b:int>>, items array<bigint>")
    def finds(texts: pd.Series) -> pd.DataFrame:
        automaton = held(key, lambda: Automaton(sent.value))
        found = [automaton.scan(words_of(t)) for t in texts]
        give_back()
        return pd.DataFrame({"runs": [[{"a": a, "b": b} for a, b in runs] for runs, _ in found], "items": [sorted(items) for _, items in found]})
    met = texts.select("t", finds("t").alias("f")).filter("size(f.runs) > 0").select(F.sha2("t", 256).alias("sha"), "f.runs", "f.items")
    out = stored(met.dropDuplicates(["sha"]), "part-hits")
    sent.destroy()
    return out


def _hits_by_parts(plain: DataFrame, text: Column, name: str, windows: DataFrame, n_parts: int) -> DataFrame:
    """``plain`` with the hits of all parts in the struct ``name``. Only texts that may have any meet the stored finds."""
    texts, found = plain.select(text.alias("t")), None
    for part in range(n_parts):
        hits = _part_hits(texts, windows, part)
        found = hits if found is None else found.unionByName(hits)
    finds, sha = free_name("_finds", [*plain.columns, name]), free_name("_sha", [*plain.columns, name])
    merged = stored(found.groupBy("sha").agg(F.struct(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
                                             .alias("finds")), "hits").select(F.col("sha").alias(sha), F.col("finds").alias(finds))
    place = F.pmod(F.xxhash64(F.sha2(text, 256)), F.lit(_FILTER_BITS))
    held_bits = stored(bit_words(merged.select(F.pmod(F.xxhash64(sha), F.lit(_FILTER_BITS)).alias("p")), _FILTER_BITS), "hit-bits")
    maybe = F.coalesce(bit_at(held_bits.scalar(), place), F.lit(False))

    @F.pandas_udf(HITS)
    def summed(texts: pd.Series, runs: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for t, r, i in zip(texts, runs, items):
            pairs = [] if r is None else [(int(x["a"]), int(x["b"])) for x in r]
            out.append(_summed(t, len(words_of(t)), pairs, [] if i is None else [int(x) for x in i]))
        return pd.DataFrame(out, columns=list(HIT_COLUMNS))
    nothing = F.struct(F.regexp_count(text, F.lit(_GAP_FREE)).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
                       F.array().cast("array<bigint>").alias("items"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    met = plain.filter(maybe).withColumn(sha, F.sha2(text, 256)).join(merged, sha, "left")
    met = met.withColumn(name, summed(text, F.col(f"{finds}.runs"), F.col(f"{finds}.items")))
    columns = [*[f"`{c}`" for c in plain.columns], name]
    return plain.filter(~maybe).withColumn(name, nothing).select(*columns).unionByName(met.select(*columns))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns.

    Null and empty texts, and all rows if the benchmark is empty, stay; repeated rows are judged alike."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return benchmark_hits(rows, benchmark, "row", "text", **options).filter("n_hit = 0").select("row.*")
