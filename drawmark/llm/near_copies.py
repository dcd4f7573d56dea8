"""Near copies by SimHash and the Jaccard similarity of their sets of word shingles, as the pipeline's near-dedup stage takes them.

1. One pass over the texts gives each its set's digest, the set's SimHash fingerprint and keys of MinHash bands. Equal sets
   become one row. With ``BANDS`` bands of ``ROWS`` minima, two sets of similarity 0.8 share a key with a probability of 0.999995.
2. Fingerprints that share a key are compared bit-sliced (``simhash.bucket_links``, large keys block against block); those within
   ``RADIUS`` are linked loosely, and so are sets of one fingerprint. At a similarity of 0.8 a bit differs with a probability
   of 0.15 (0.19 in sets of four and five shingles), so a pair passes the radius with a probability of 0.99999 or more.
3. Loose components, of which most texts have none, are brought together with their sets, and every pair in one is
   checked exactly. Components of over ``BLOCK`` shingles or ``SETS`` sets are cut into blocks, and every pair of blocks is a
   group of its own.
4. Components of the links that passed (``components``)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.llm.bitslice import joined_roots
from drawmark.llm.common import bit_at, bit_words, give_back, stored, without_keys
from drawmark.llm.components import component_labels
from drawmark.llm.simhash import bucket_links, hashes_fingerprint

WORDS, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS = 40, 6
RADIUS = 26  # bits of the fingerprints in which similar sets differ at most
BLOCK = 1 << 19  # shingles of a group of sets compared with each other
SETS = 512  # and its sets
FILTER_BITS = 1 << 22
_AT_ONCE = 512  # shingles hashed anew for all minima at a time
_RANDOM = np.random.default_rng(SEED)
_FACTORS, _OFFSETS, _MIX = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(3))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, ascending; a shorter text is one run, one without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    width = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    n = len(tokens) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1:].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n))


def set_digest(values: np.ndarray) -> int:
    """A set's digest as a signed number; zero for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), SEED)).astype(np.int64)) if len(values) else 0


def band_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the bands; the empty set has none."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(values), _AT_ONCE):
        least = np.minimum(least, (_FACTORS[:, None] * values[None, k:k + _AT_ONCE] + _OFFSETS[:, None]).min(axis=1))
    # every place has a factor of its own, so bands do not meet each other
    mixed = (least ^ (least >> np.uint64(31))) * _MIX
    keys = (mixed ^ (mixed >> np.uint64(29))).reshape(BANDS, ROWS) * _FACTORS[:ROWS]
    return keys.sum(axis=1, dtype=np.uint64).view(np.int64)


def _set_links(flat: np.ndarray, sizes: np.ndarray, asking: np.ndarray, similar: float) -> np.ndarray:
    """Root of each set after joining all pairs of sets, one of them ``asking``, at least ``similar`` to each other.

    A set's overlaps with all others come from the lists of the sets that have each of its shingles."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
    lists = owner[np.argsort(token, kind="stable")]
    begin = np.cumsum(df) - df
    at = np.cumsum(sizes) - sizes
    root = np.arange(n)
    for i in np.flatnonzero(asking):
        if (root == root[i]).all():
            break
        own = token[at[i]:at[i] + sizes[i]]
        own = own[df[own] > 1]
        if not len(own):
            continue
        shared = np.zeros(n, dtype=np.int64)
        for t in own:
            shared[lists[begin[t]:begin[t] + df[t]]] += 1  # a set has a shingle once
        met = np.flatnonzero(shared >= similar * (sizes[i] + sizes - shared) - 1e-9)
        met = met[root[met] != root[i]]
        if len(met):
            root = joined_roots(root, np.full(len(met), i), met)
    return root


def _checked(batches: Iterator[pa.RecordBatch], similar: float, block: int) -> Iterator[pa.RecordBatch]:
    """Links that connect the similar sets of each group (label, pair) of rows sorted by group and side."""
    def links(rows: list[tuple]) -> pa.RecordBatch:
        fps = np.array([r[3] for r in rows], dtype=np.int64)
        side = np.array([r[2] for r in rows])
        asking = side == 0 if side.any() else np.ones(len(rows), dtype=bool)
        root = _set_links(np.concatenate([r[4] for r in rows]), np.array([len(r[4]) for r in rows]), asking, similar)
        linked = root != np.arange(len(rows))
        give_back()
        return pa.record_batch([pa.array(fps[linked]), pa.array(fps[root[linked]])], names=["a", "b"])

    group, rows = None, []
    for batch in batches:
        label, pair, side, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "pair", "side", "fp"))
        sets = batch.column("shingles")
        for k in range(batch.num_rows):
            if (label[k], pair[k]) != group:
                if len(rows) > 1:
                    yield links(rows)
                group, rows = (label[k], pair[k]), []
            rows.append((label[k], pair[k], side[k], fp[k], np.array(sets[k].values.to_numpy(zero_copy_only=False))))
    if len(rows) > 1:
        yield links(rows)


def loose_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of the fingerprints within ``radius`` among sets that share a key (columns fp, sim, bands)."""
    placed = distinct.select("sim", F.explode("bands").alias("key"))
    # stored, so that both sides of the join are dealt out for it alone and a large key is split
    shared = stored(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    met = placed.join(shared, "key").select(F.lit(0).alias("band"), "key", F.col("sim").alias("fp")).distinct()
    return bucket_links(stored(met, "buckets"), radius)


def loose_members(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Sets that have others in their loose component: fp, label, first_id."""
    links = component_labels(loose_links(distinct, radius))
    linked = links.select(F.col("node").alias("sim"), "label").unionByName(links.select(F.col("label").alias("sim"), "label").distinct())
    shared = distinct.groupBy("sim").agg(F.count("*").alias("n")).filter("n > 1").select("sim", F.col("sim").alias("label"))
    # a fingerprint of several sets is a component even without a link
    labels = linked.unionByName(shared).groupBy("sim").agg(F.min("label").alias("label"))
    return distinct.select("fp", "sim", "first_id").join(stored(labels, "loose-labels"), "sim").select("fp", "label", "first_id")


def similar_links(docs: DataFrame, loose: DataFrame, id_: Column, text: Column, words: int, similar: float, block: int) -> DataFrame:
    """Links (a, b) that connect the similar sets within each loose component (columns fp, first_id, label)."""
    place = F.pmod(F.xxhash64("first_id"), F.lit(FILTER_BITS))
    wanted = stored(bit_words(loose.filter("first_id IS NOT NULL").select(place.alias("p")), FILTER_BITS), "loose-bits")

    @F.pandas_udf("fp bigint, shingles array<bigint>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, words) for t in texts]
        give_back()
        return pd.DataFrame({"fp": [set_digest(s) for s in found], "shingles": [s.view(np.int64) for s in found]})

    rows = docs.select(id_.alias("first_id"), text.alias("text"))
    rows = rows.filter(F.col("first_id").isNull() | bit_at(wanted.scalar(), place)).select("first_id", sets("text").alias("s")).select("first_id", "s.*")
    given = loose.withColumnRenamed("first_id", "_first")
    met = rows.join(given, "fp").filter(F.col("first_id").eqNullSafe(F.col("_first"))).select("fp", "label", "shingles").dropDuplicates(["fp"])
    met = stored(met, "loose-sets")
    large = (met.groupBy("label").agg(F.sum(F.size("shingles")).alias("n"), F.count("*").alias("sets")).filter((F.col("n") > block) | (F.col("sets") > SETS))
             .select("label", F.ceil(F.greatest(F.col("n") * 2 / block, F.col("sets") * 2 / SETS)).cast("int").alias("n_blocks")))
    blocks = F.col("n_blocks")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        (F.least(own, o) * blocks + F.greatest(own, o)).alias("pair"), (own > o).cast("int").alias("side")))
    whole = F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))
    groups = (met.join(stored(large, "large-components"), "label", "left")
              .withColumn("p", F.explode(F.when(blocks.isNull(), whole).otherwise(others)))
              .select("label", F.col("p.pair").alias("pair"), F.col("p.side").alias("side"), "fp", "shingles"))
    dealt = groups.repartition("label", "pair").sortWithinPartitions("label", "pair", "side", "fp")
    return dealt.mapInArrow(lambda batches: _checked(batches, similar, block), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR,
                block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest doc_id that links lead to, itself included). Two
    texts are linked if their sets of shingles have a Jaccard similarity of at least ``similar``.

    Texts without words, null ones included, are alike. Null ids never name a component, unless it has no other id."""
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    @F.pandas_udf("fp bigint, sim bigint, bands array<bigint>")
    def keys(texts: pd.Series) -> pd.DataFrame:
        fps, sims, bands = [], [], []
        for t in texts:
            values = shingles(t, words)
            fps.append(set_digest(values))
            sims.append(hashes_fingerprint(values))
            bands.append(band_keys(values))
        give_back()
        return pd.DataFrame({"fp": fps, "sim": sims, "bands": bands})

    rows = stored(docs.select(id_.alias("doc_id"), keys(text).alias("k")).select("doc_id", "k.*"), "set-keys")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.max("sim").alias("sim"), F.max("bands").alias("bands")), "distinct-sets")
    members = stored(loose_members(distinct), "loose-members")
    links = component_labels(similar_links(docs, members, id_, text, words, similar, block))
    joined = links.select(F.col("node").alias("fp"), "label").unionByName(links.select(F.col("label").alias("fp"), "label").distinct())
    named = joined.join(distinct.select("fp", "first_id"), "fp")
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(names, "label").select("fp", "component_id", F.lit(True).alias("linked"))
    places = distinct.select("fp", "first_id").join(of_fp, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    return rows.select("doc_id", "fp").join(stored(places, "places"), "fp").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.

    Rows that share an id are one document, which goes if each of its rows belongs to a component with a smaller id.
    Rows without an id stay."""
    found = near_copies(docs, id_col, text_col, **options)
    copies = (found.filter("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).filter("copy").select("doc_id"))
    return without_keys(docs, F.col(f"`{id_col}`"), stored(copies, "near-copies"))
