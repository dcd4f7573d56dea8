"""Connected components of an edge table, in rounds of DataFrame operations.

Alternates two star operations (Kiveris and others, "Connected Components in MapReduce and Beyond", 2014): each node
hands its smallest neighbour to its larger neighbours, then to its smaller ones. Every round is written to the shared
folder, so lineage stays short and a lost executor costs one round. Neighbour lists are never gathered: minima are
combined in the map tasks, and a hub's edges meet its one row of the minima table in a join that is split when skewed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawmark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored, so that both sides of the join are dealt out for it alone and a hub is split
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with a smaller one in its component: label is the component's smallest node.

    ``edges``: columns a and b of one orderable type; direction, repetition and loops do not matter, edges with a null
    end are left out. An empty table gives an empty table."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = None
    while True:
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFF)))).first()
        if after[0] == 0 or after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = after
        now = stored(_small_star(_large_star(now)), "edges")
