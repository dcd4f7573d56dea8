"""Near-duplicates by SimHash fingerprints and bit-sliced comparison.

1. Fingerprints: one pass over the texts (vectorised in Python workers); afterwards only 64-bit numbers move.
2. Equal fingerprints become one row, so groups of copies of any size cost nothing further.
3. Candidates: the 64 bits are cut into bands; two fingerprints within the radius differ in at most ``radius`` bands,
   so they agree in all others. For each choice of the agreeing bands, fingerprints are bucketed by those bits. With
   radius + 2 bands two agree (15 choices for radius 4, buckets of 2^-21 of all), from about 2^24 fingerprints on one
   more; this is exact for any number of bands, the number only keeps buckets small.
4. Buckets are compared bit-sliced (``bitslice``). Buckets larger than ``BLOCK`` are cut into blocks and every pair of
   blocks is a group of its own, so a task's work is bounded. A group gives out a spanning forest of its links, not pairs.
5. Components of the links (``components``)."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawmark.llm.bitslice import joined_roots, near_pairs
from drawmark.llm.common import give_back, stored, without_keys
from drawmark.llm.components import component_labels

WORDS, RADIUS, SEED = 4, 4, 42
BLOCK = 4096
_GATHERED = 1 << 16  # rows of whole groups compared at a time
_SUMMED = 1 << 14


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of a text as an unsigned number; zero without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    n = len(tokens) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _SUMMED):
        m = min(_SUMMED, n - k)
        spans = zip(starts[k:k + m].tolist(), ends[k + width - 1:k + width - 1 + m].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype="<u8", count=m)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def hashes_fingerprint(hashes: np.ndarray) -> int:
    """Fingerprint of given 64-bit hashes as a signed number; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _SUMMED):
        part = np.ascontiguousarray(hashes[k:k + _SUMMED], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number. A null text has no words."""
    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), fp(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("fp"))


def band_masks(n: int, radius: int) -> list[int]:
    """Masks of the bits that bucket ``n`` fingerprints; any two within the radius agree under at least one."""
    bands = radius + 2 if n <= 1 << 24 else radius + 3
    edges = [64 * k // bands for k in range(bands + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, bands - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each group (band, key, pair) of rows sorted by group, side and fp."""
    names, kept, n_kept = ("band", "key", "pair", "side", "fp"), [], 0

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        band, key, pair, side, fp = rows
        n = len(fp)
        change = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        start = np.concatenate([[0], change])
        size = np.diff(np.concatenate([start, [n]]))
        # lone rows have nothing to meet; most buckets of a clean corpus are such
        own = np.repeat(size > 1, size)
        fp, side, size = fp[own], side[own], size[size > 1]
        if not len(fp):
            return pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
        end = np.repeat(np.cumsum(size), size)
        n_second = np.add.reduceat(side.astype(np.int64), np.cumsum(size) - size)
        crossing = np.repeat(n_second, size)
        at = np.arange(len(fp))
        # within a block: all later rows; between blocks: rows of the other side
        lo = np.where(crossing > 0, np.where(side == 0, end - crossing, end), at + 1)
        root = at
        for i, j in near_pairs(fp.view(np.uint64), lo, end, radius):
            root = joined_roots(root, i, j)
        linked = root != at
        return pa.record_batch([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    for batch in batches:
        kept.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n_kept += batch.num_rows
        if n_kept < _GATHERED:
            continue
        rows = [np.concatenate(c) for c in zip(*kept)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        cut = int(np.argmax(last))  # the last group may go on in the next batch; it has two blocks of rows at most
        if cut:
            yield links([c[:cut] for c in rows])
        kept, n_kept = [[c[cut:] for c in rows]], len(last) - cut
    if n_kept:
        yield links([np.concatenate(c) for c in zip(*kept)])


def fingerprint_links(distinct: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` of each other (column fp, distinct, ``n`` rows)."""
    masks = band_masks(n, radius)
    fp = F.col("fp")
    placed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("at")).select("fp", "at.*")
    return bucket_links(placed, radius, block)


def bucket_links(placed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the fingerprints within ``radius`` of each other in each bucket (columns band, key, fp)."""
    large = (placed.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
             .select("band", "key", F.ceil(F.col("n") * 2 / block).cast("int").alias("n_blocks")))
    large = stored(large, "large-buckets")
    columns = ["band", "key", "pair", "side", "fp"]
    if large.isEmpty():
        groups = placed.withColumns({"pair": F.lit(0), "side": F.lit(0)}).select(*columns)
    else:
        met = placed.join(large, ["band", "key"], "left")
        blocks = F.col("n_blocks")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
            (F.least(own, o) * blocks + F.greatest(own, o)).alias("pair"), (own > o).cast("int").alias("side")))
        groups = (met.withColumn("p", F.explode(F.when(blocks.isNull(), F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))).otherwise(others)))
                  .select("band", "key", F.col("p.pair").alias("pair"), F.col("p.side").alias("side"), "fp"))
    dealt = groups.repartition("band", "key", "pair").sortWithinPartitions(*columns)
    return dealt.mapInArrow(lambda batches: _compared(batches, radius), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links lead to, itself included).

    Texts without words, null ones included, have fingerprint zero and link like any other. Null ids belong to the
    component of their fingerprint and never name it, unless it has no other id: then component_id is null. Repeated
    rows share a component. An empty table gives an empty result."""
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = component_labels(fingerprint_links(distinct.select("fp"), distinct.count(), radius, block))
    members = links.select(F.col("node").alias("fp"), "label").unionByName(links.select(F.col("label").alias("fp"), "label").distinct())
    named = members.join(distinct, "fp")
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(names, "label").select("fp", "component_id", F.lit(True).alias("linked"))
    places = distinct.join(of_fp, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    # stored, so that both sides of the last join are dealt out for it alone and a fingerprint of very many rows is split
    return fps.join(stored(places, "places"), "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.

    Rows that share an id are one document, which goes if each of its rows belongs to a component with a smaller id.
    Rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    copies = (found.filter("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).filter("copy").select("doc_id"))
    return without_keys(docs, F.col(f"`{id_col}`"), stored(copies, "near-copies"))
