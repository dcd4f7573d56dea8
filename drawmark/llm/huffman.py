"""Token ids in Huffman-coded files.

The files are Parquet folders: ``blocks`` (independent blocks of whole documents), ``codes`` (the code lengths, one
row) and ``shards`` (ids before each shard). Code lengths come from the counts of all ids of the corpus, limited to
``LIMIT`` bits, so decoding is one look-up in a table of 2^LIMIT entries per id; codes are canonical, so lengths are all
that is stored. A document starts at a byte; every ``SEGMENT`` ids of a document a checkpoint holds the bit offset in
the block, so the segments of a block are decoded side by side.

Writing: encode each text once and count its ids, keep both in the shared folder; Huffman-code the documents where they are;
move the coded documents to shards of ascending id ranges (boundaries from an approximate percentile, so a shard's
size is even; exact order within it by sorting); assemble blocks. Only counts, boundaries and shard sizes reach the
driver: at most the vocabulary's size and the number of shards."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.common import give_back, stored
from drawmark.llm.encode import encoder

LIMIT, SEGMENT, BLOCK_IDS = 16, 256, 1 << 16
END_ID = 2
BLOCKS = "shard int, block int, first bigint, doc_ids array<bigint>, n_ids array<bigint>, checkpoints binary, payload binary"
_DECODED_BYTES = 8 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits (package-merge); zero for ids that do not occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    taken, rank = 2 * len(leaves) - 2, np.arange(len(leaves))
    sums = np.zeros(len(leaves), dtype=np.uint8)
    for flags in reversed(is_leaf):
        n_leaves = int(flags[:taken].sum())
        sums += rank < n_leaves
        taken = 2 * (taken - n_leaves)
    lengths[used] = sums
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the order of their codes, codes by id): shorter codes first, equal lengths by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.uint64)
    top = np.uint64(n.max(initial=1))
    begins = np.concatenate([[0], np.cumsum(np.uint64(1) << (top - n))[:-1]]).astype(np.uint64) if len(n) else n
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[order] = begins >> (top - n)
    return order, codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``limit`` bits."""
    order, _ = canonical_codes(lengths)
    spread = 1 << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << limit, dtype="<u4"), np.ones(1 << limit, dtype=np.int64)
    n = int(spread.sum())
    ids[:n] = np.repeat(order, spread)
    sizes[:n] = np.repeat(lengths[order].astype(np.int64), spread)
    return ids, sizes


def packed(ids: np.ndarray, n_ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray,
           segment: int = SEGMENT) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``n_ids`` ids each, one after the other: (bits, first byte of each document and the end, bit offset
    within its document of each segment, number of segments of each document)."""
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(n_ids)
    doc_bits = ends[last] - ends[last - n_ids]
    edges = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
    at = ends[:-1] + np.repeat(edges[:-1] * 8 - ends[last - n_ids], n_ids)
    word, over = at >> 6, (at & 63) + size - 64
    code = codes[ids]
    inside = over <= 0
    value = np.where(inside, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    out = np.zeros((int(edges[-1]) >> 3) + 2, dtype=np.uint64)
    if len(word):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[starts]] = np.add.reduceat(value, starts)  # bits of a word's codes are disjoint
        split = np.flatnonzero(~inside)
        out[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    n_segments = -(-n_ids // segment)
    first = np.repeat(last - n_ids, n_segments) + segment * (np.arange(int(n_segments.sum())) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments))
    offsets = at[first] - np.repeat(edges[:-1] * 8, n_segments) if len(first) else first
    return out.astype(">u8").tobytes()[:int(edges[-1])], edges, offsets, n_segments


def unpacked(payload: bytes, offsets: np.ndarray, n_segment: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """Ids of the segments that start at the bit ``offsets``, one step for the next id of all segments together."""
    raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-n_segment, kind="stable")
    at, left = offsets[order].astype(np.int64), n_segment[order]
    place = (np.cumsum(n_segment) - n_segment)[order]
    out = np.empty(int(n_segment.sum()), dtype="<u4")
    ids, sizes = table
    mask = (1 << limit) - 1
    active = np.searchsorted(-left, -np.arange(int(left[0])), side="left") if len(left) else ()
    for step, n in enumerate(active):  # segments with more than ``step`` ids
        now = at[:n]
        peek = (ahead[now >> 3] >> (32 - limit - (now & 7)).astype(np.uint32)) & mask
        out[place[:n] + step] = ids[peek]
        now += sizes[peek]
    return out


def _id_type(n_vocabulary: int) -> str:
    return "<u2" if n_vocabulary <= 1 << 16 else "<u4"


def encoded_ids(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, kind: str, n_vocabulary: int) -> DataFrame:
    """(doc_id, ids, counts): the ids of each text and the end id, as little-endian numbers of the type ``kind``; and a row
    for each task, without ids, with how often the task met each id, as pairs of 64-bit numbers."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, tail = encoder(path).encode, np.array([end_id], dtype=kind).tobytes()
        total = np.zeros(n_vocabulary, dtype=np.int64)
        for b in batches:
            rows = [np.frombuffer(encode_text(t), dtype="<u4").astype(kind).tobytes() + tail for t in b.column(1).to_pylist()]
            total += np.bincount(np.frombuffer(b"".join(rows), dtype=kind), minlength=n_vocabulary)
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "ids", "counts"])
            give_back()
        used = np.flatnonzero(total)
        pairs = np.stack([used, total[used]], axis=1).astype("<i8").tobytes()
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs])], names=["doc_id", "ids", "counts"])
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids binary, counts binary")


def id_counts(encoded: DataFrame, n_vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' counts."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "n"])
    rows = (encoded.filter("counts IS NOT NULL").select("counts").mapInArrow(pairs, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(n_vocabulary, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def _coded_documents(encoded: DataFrame, kind: str, lengths: np.ndarray, codes: np.ndarray, segment: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            n = np.array([len(r) for r in raw], dtype=np.int64) // np.dtype(kind).itemsize
            bits, edges, offsets, n_segments = packed(np.frombuffer(b"".join(raw), dtype=kind), n, lengths, codes, segment)
            ends = np.cumsum(n_segments)
            marks = offsets.astype("<u8")
            yield pa.record_batch([
                b.column(0), b.column(1), pa.array(n),
                pa.array([marks[e - k:e].tobytes() for e, k in zip(ends, n_segments)], pa.binary()),
                pa.array([bits[x:y] for x, y in zip(edges, edges[1:])], pa.binary())], names=["shard", "doc_id", "n", "marks", "bits"])
    return encoded.mapInArrow(code, "shard int, doc_id bigint, n bigint, marks binary, bits binary")


def _blocks(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard after the other, in order, gathered to blocks of at least ``block_ids`` ids."""
    shard, block, first, size, held = None, 0, 0, 0, []

    def closed() -> pa.RecordBatch:
        ids, n, marks, bits = zip(*held)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in bits])[:-1]]) * 8
        offsets = np.concatenate([np.frombuffer(m, dtype="<u8").astype(np.int64) + s for m, s in zip(marks, starts)])
        if offsets.max() >= 1 << 32:
            raise ValueError("a block of over 2^32 bits")
        return pa.record_batch([
            pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([list(ids)], pa.list_(pa.int64())),
            pa.array([list(n)], pa.list_(pa.int64())), pa.array([offsets.astype("<u4").tobytes()], pa.binary()), pa.array([b"".join(bits)], pa.binary())],
            names=["shard", "block", "first", "doc_ids", "n_ids", "checkpoints", "payload"])

    for b in batches:
        for s, *row in zip(*(b.column(k).to_pylist() for k in range(5))):
            if held and (s != shard or size >= block_ids):
                yield closed()
                block, first, size, held = block + 1, first + size, 0, []
            if s != shard:
                shard, block, first = s, 0, 0
            held.append(row)
            size += row[1]
    if held:
        yield closed()


def write_ids(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
              limit: int = LIMIT, segment: int = SEGMENT, block_ids: int = BLOCK_IDS) -> None:
    """Write the token ids of all texts, each followed by ``end_id``, below the folder ``out`` in ascending id order.

    Null and empty texts are the end id alone. Null ids come first; rows with one id stand in an order of their own
    content. A block holds whole documents, so one longer than ``block_ids`` is a block of its own. An empty table
    gives empty folders."""
    spark = docs.sparkSession
    library = encoder(path).library
    n_vocabulary = max(library.get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = _id_type(n_vocabulary)
    written = stored(encoded_ids(docs, path, id_col, text_col, end_id, kind, n_vocabulary), "token-ids")
    lengths = code_lengths(id_counts(written, n_vocabulary), limit)
    encoded = written.filter("ids IS NOT NULL")
    codes = canonical_codes(lengths)[1]
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n_shards for k in range(1, n_shards)] or [0.5]
    bounds = sorted(set(encoded.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()["b"] or []))
    shard = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    coded = _coded_documents(encoded.select(F.when(F.col("doc_id").isNull(), 0).otherwise(shard).cast("int").alias("shard"), "doc_id", "ids"),
                             kind, lengths, codes, segment)
    placed = coded.repartition("shard").sortWithinPartitions("shard", "doc_id", "n", "bits")
    placed.mapInArrow(lambda rows: _blocks(rows, block_ids), BLOCKS).write.parquet(f"{out}/blocks")
    sizes = {r["shard"]: r["n"] for r in spark.read.schema(BLOCKS).parquet(f"{out}/blocks").groupBy("shard").agg(
        F.sum(F.aggregate("n_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect()}
    before, rows = 0, []
    for s in sorted(sizes):
        rows.append((s, before))
        before += sizes[s]
    spark.createDataFrame(rows, "shard int, ids_before bigint").coalesce(1).write.parquet(f"{out}/shards")
    spark.createDataFrame([(bytearray(lengths.tobytes()), limit, segment)], "lengths binary, bits int, segment int").coalesce(1).write.parquet(f"{out}/codes")


def _decoded(batches: Iterator[pa.RecordBatch], lengths: bytes, limit: int, segment: int, give) -> Iterator[pa.RecordBatch]:
    table = decoding_table(np.frombuffer(lengths, dtype=np.uint8), limit)
    for b in batches:
        shards, firsts, doc_ids, n_ids, marks, payloads = (b.column(k).to_pylist() for k in range(6))
        begin = 0
        while begin < len(payloads):
            end, held = begin, 0
            while end < len(payloads) and (end == begin or held + len(payloads[end]) <= _DECODED_BYTES):
                held += len(payloads[end])
                end += 1
            part = slice(begin, end)
            n = [np.array(x, dtype=np.int64) for x in n_ids[part]]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in payloads[part]])[:-1]]).astype(np.int64) * 8
            offsets = np.concatenate([np.frombuffer(m, dtype="<u4").astype(np.int64) + s for m, s in zip(marks[part], starts)])
            flat = np.concatenate(n)
            n_segments = -(-flat // segment)
            sizes = np.full(int(n_segments.sum()), segment, dtype=np.int64)
            sizes[np.cumsum(n_segments) - 1] = flat - (n_segments - 1) * segment
            ids = unpacked(b"".join(payloads[part]), offsets, sizes, table, limit)
            edges = np.concatenate([[0], np.cumsum(flat)])
            within = np.concatenate([f + np.cumsum(x) - x for f, x in zip(firsts[part], n)])
            of_block = np.repeat(np.array(shards[part]), [len(x) for x in n])
            yield give(of_block, [i for d in doc_ids[part] for i in d], within, flat, ids, edges)
            begin = end


def _read(spark: SparkSession, folder: str, give, schema: str) -> DataFrame:
    code = spark.read.parquet(f"{folder}/codes").first()
    lengths, limit, segment = bytes(code["lengths"]), code["bits"], code["segment"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("shard", "first", "doc_ids", "n_ids", "checkpoints", "payload")
    rows = blocks.mapInArrow(lambda b: _decoded(b, lengths, limit, segment, give), f"shard int, doc_id bigint, within bigint, {schema}")
    shards = F.broadcast(spark.read.parquet(f"{folder}/shards"))  # one row per shard
    return rows.join(shards, "shard").withColumn("start", F.col("within") + F.col("ids_before")).drop("shard", "within", "ids_before")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): all documents of the folder, ``start`` being the number of ids before the document."""
    def give(shard, doc_ids, within, n, ids, edges) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64)))
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(within), lists],
                               names=["shard", "doc_id", "within", "ids"])
    return _read(spark, folder, give, "ids array<bigint>").select("doc_id", "start", "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksums of the ids as little-endian unsigned 32-bit numbers."""
    def give(shard, doc_ids, within, n, ids, edges) -> pa.RecordBatch:
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(within), pa.array(n), pa.array(sums, pa.int64())],
                               names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"])
    return _read(spark, folder, give, "n_tokens bigint, ids_crc32 bigint").select("doc_id", "start", "n_tokens", "ids_crc32")
