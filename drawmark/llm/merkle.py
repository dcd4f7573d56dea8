"""Merkle manifest of a dataset: one hash tree per source over its rows in id order, and one over the sources' roots.

Runs of ``ARITY`` neighbours become one node until one is left. The rows' numbers within their source come from a range
exchange over narrow rows and the counts of its partitions, so a source that holds a third of all rows is spread like
any other. Aligned subtrees of ``HEIGHT`` levels are blocks: each is built from a bounded number of leaves and stored in
van Emde Boas layout. Block roots are the leaves of the next layer of blocks, so the number of layers grows with the
logarithm of the rows. Proofs are read from the top layer down: each layer adds the siblings within a block, at addresses
that follow from the node's number."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawmark.llm.common import stored
from drawmark.llm.veb_blocks import built, siblings

ARITY, HEIGHT = 3, 6
PROOF = "array<struct<before:string,after:string>>"


def row_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hexadecimal) of a row: each field as ``bytes:value``, ``-`` for null."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the number from zero within ``tree`` by ``order`` (nulls first), and n, the rows of the tree."""
    # ties go by the digest; a last column splits rows that are alike in all, however many
    wide = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(wide.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "merkle-rows")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("own"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("tree", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(by_tree).alias("n")), "merkle-counts")
    local = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie"))
    return placed.withColumn("local", local).join(counts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("local") - 1).drop("before", "local", "part", "tie")


def _layers(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Layers of blocks (tree, block, n_leaves, height, nodes, root, rows), lowest first, over ``nodes`` (tree, pos, n, digest, row), and
    the roots (tree, root)."""
    @F.pandas_udf("nodes binary, root string")
    def hashed(leaves: pd.Series, heights: pd.Series) -> pd.DataFrame:
        rows = [built([bytes.fromhex(x) for x in own], int(h), arity) for own, h in zip(leaves, heights)]
        return pd.DataFrame({"nodes": rows, "root": [r[:32].hex() for r in rows]})
    width = arity ** height
    powers = F.array(*[F.lit(arity ** k) for k in range(height)])
    layers: list[DataFrame] = []
    roots = None
    while True:
        grouped = nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("rows"), F.first("n").alias("n"))
        shaped = grouped.select("*", F.size(F.filter(powers, lambda p: p < F.col("n"))).alias("height"))
        found = shaped.withColumn("h", hashed(F.transform("rows", lambda r: r["digest"]), F.col("height")))
        layer = stored(found.select("tree", "block", "n", F.size("rows").alias("n_leaves"), "height", "rows", "h.nodes", "h.root"), "merkle-layer")
        layers.append(layer)
        done = layer.filter(F.col("n") <= width).select("tree", "root")
        roots = done if roots is None else roots.unionByName(done)
        above = layer.filter(F.col("n") > width)
        if above.isEmpty():
            return layers, roots
        nodes = above.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("root").alias("digest"), F.lit(None).cast("int").alias("row"))


def _proofs(layers: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, digest, row, proof) of all leaves; ``tops`` (tree, above) holds what follows each tree's root."""
    @F.pandas_udf(f"array<{PROOF}>")
    def steps(nodes: pd.Series, sizes: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([[[{"before": a, "after": b} for a, b in level] for level in siblings(x, int(n), int(h), arity)]
                          for x, n, h in zip(nodes, sizes, heights)])
    known = None
    for layer in reversed(layers):
        # blocks that are a whole tree go on with the tree's own way up, others with that of their root one layer above
        ways = layer.select("tree", "block").join(tops, "tree")
        if known is not None:
            ways = ways.join(known.select("tree", F.col("pos").alias("block"), F.col("proof").alias("way")), ["tree", "block"], "left")
            ways = ways.select("tree", "block", F.coalesce("way", "above").alias("above"))
        read = layer.join(ways, ["tree", "block"]).withColumn("steps", steps("nodes", "n_leaves", "height"))
        own = F.transform("rows", lambda r, i: F.struct(
            r["pos"].alias("pos"), r["digest"].alias("digest"), r["row"].alias("row"),
            F.concat(F.transform("steps", lambda level, k: F.get(level, F.floor(i / F.pow(F.lit(arity), k)).cast("int"))), F.col("above")).alias("proof")))
        known = read.select("tree", F.inline(own))
        if layer is not layers[0]:
            known = stored(known.select("tree", "pos", "proof"), "merkle-ways")
    return known


def manifest_proofs(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``leaves`` (source, id, digest and any row: one struct of further columns) with subroot, root and proof.

    proof lists, from the leaf to the root, the digests of the run's others on the left and on the right, as text one
    after the other. Sources are ordered by their UTF-8 bytes, null first, and rows by id, null first; rows with equal id
    by digest, and rows alike in both take their places in any order. A source with one row is its leaf; an empty table
    gives no rows."""
    # one letter in front keeps null apart and first
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    rows = leaves.select(tree.alias("tree"), "id", "digest", F.struct("source", "id", "row").alias("row"))
    layers, roots = _layers(_numbered(rows, ["id", "digest"]).drop("id"), arity, height)
    roots = stored(roots, "merkle-roots")
    over = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.struct("tree").alias("row"))
    top_layers, top_roots = _layers(_numbered(over, ["name"]).drop("name"), arity, height)
    nothing = F.array().cast(PROOF)
    tops = _proofs(top_layers, top_roots.select("tree", nothing.alias("above")), arity)
    tops = stored(tops.select(F.col("row.tree").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("above")), "merkle-tops")
    found = _proofs(layers, tops.select("tree", "above"), arity)
    root = top_roots.select("root")
    return (found.join(tops.select("tree", "subroot"), "tree").withColumn("root", root.scalar())
            .select("row.source", "row.id", "digest", "row.row", "subroot", "root", "proof"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all digests of a proof, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))
