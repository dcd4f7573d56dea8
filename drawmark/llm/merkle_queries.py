"""Merkle manifest of all documents, and its check against tampered texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.merkle import folded, manifest_proofs, proof_digest, row_digest
from drawmark.llm.queries import CRC_SQL, query, table

_FIELDS = ("doc_id", "source", "lang", "n_chars")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*_FIELDS, text)) + ")"


@query("op13_merkle_manifest", sql=f"""
WITH RECURSIVE {CRC_SQL},
docs AS (SELECT d.*, crc FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, crc FROM crcs) USING (doc_id)),
leaves AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
                  CASE WHEN crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM docs),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, level AS top FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 3),
root AS (SELECT h AS root FROM tops WHERE n = 1),
steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
                 coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
top_steps AS (SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
                     coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
              FROM tops a JOIN tops b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY a.level, a.place),
way AS (
  SELECT s.tree, p.pos AS id, s.level, s.before, s.after FROM placed p JOIN steps s ON s.tree = p.tree AND s.pos = p.pos // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.pos, r.top + t.level, t.before, t.after FROM placed p JOIN subroots r USING (tree) JOIN top_steps t ON t.place = r.place // CAST(pow(3, t.level) AS BIGINT)),
proofs AS (SELECT tree, id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM way GROUP BY tree, id),
folds AS (
  SELECT tree, pos AS id, 0 AS level, coalesce(changed, leaf) AS h FROM placed
  UNION ALL
  SELECT f.tree, f.id, f.level + 1, sha256(w.before || f.h || w.after) FROM folds f JOIN way w USING (tree, id, level)),
ends AS (SELECT tree, id, h AS folded_root FROM folds QUALIFY level = max(level) OVER (PARTITION BY tree, id))
SELECT p.doc_id, p.leaf, r.subroot, root.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subroots r USING (tree) CROSS JOIN root JOIN ends e ON e.tree = p.tree AND e.id = p.pos LEFT JOIN proofs q ON q.tree = p.tree AND q.id = p.pos""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = [F.col(c) for c in _FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    # a text without line feeds is the same when tampered with
    changed = F.when(tampered & F.contains("text", F.lit("\n")), row_digest(*named, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select("source", F.col("doc_id").alias("id"), row_digest(*named, F.col("text")).alias("digest"), F.struct(changed.alias("changed")).alias("row"))
    proofs = manifest_proofs(leaves)
    found = proofs.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                          folded(F.coalesce("row.changed", "digest"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
