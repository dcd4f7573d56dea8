"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the full text.

Each step only hashes documents whose group of the step before has more than one member. Which groups those are
goes to the next scan as a bit set of fixed size over the group keys' hashes. A bit shared by two groups lets a few
more documents through, and the counts of the last step are exact, so the bit set's size only affects speed.
Texts are not shuffled: what moves are ids, lengths and hashes, and groups are counted in the map tasks first, so a
group that holds a third of all rows is a few rows per task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.llm.common import bit_at, bit_words, free_name, stored

PREFIX_CHARS = 128
FILTER_BITS = 1 << 22
GROUP_COLUMNS = ("n_bytes", "text_sha256", "keep_id", "group_size", "n_at_keep")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _place(bits: int, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def _repeated(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bit set of the keys that more than one row has."""
    more = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return stored(bit_words(more.select(_place(bits, *keys).alias("p")), bits), "dedup-bits")


def _refined(rows: DataFrame, prefix_chars: int, filter_bits: int) -> tuple[Column, Column]:
    """Of ``rows`` (columns text, n_bytes): the conditions that their length, and their length and prefix, are repeated.

    Both are bit sets, so a row that fails one has a text of its own; the second looks at a prefix only if the first holds."""
    lengths = _repeated(rows.select("n_bytes"), ["n_bytes"], filter_bits)
    same_length = bit_at(lengths.scalar(), _place(filter_bits, "n_bytes"))
    prefix = F.xxhash64(F.substring("text", 1, prefix_chars))
    second = rows.filter(same_length).select("n_bytes", prefix.alias("prefix_hash"))
    prefixes = _repeated(second, ["n_bytes", "prefix_hash"], filter_bits)
    return same_length, bit_at(prefixes.scalar(), _place(filter_bits, F.col("n_bytes"), prefix))


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                     filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per text that more than one row of ``docs`` has: n_bytes, text_sha256 (hexadecimal), keep_id (the
    largest id; null only if all are null), group_size, n_at_keep (number of rows with keep_id).

    A null text counts as empty. Rows equal in id and text count each. No rows for an empty table."""
    rows = _sized(docs, id_col, text_col)
    return _groups(rows, _refined(rows, prefix_chars, filter_bits))


def _groups(rows: DataFrame, refined: tuple[Column, Column]) -> DataFrame:
    third = rows.filter(refined[0]).filter(refined[1])
    hashed = third.select("id", "n_bytes", F.sha2("text", 256).alias("text_sha256"))
    per_id = hashed.groupBy("n_bytes", "text_sha256", "id").agg(F.count("*").alias("n"))
    top = F.max(F.struct("id", "n"))
    return (per_id.groupBy("n_bytes", "text_sha256")
            .agg(top["id"].alias("keep_id"), F.sum("n").alias("group_size"), top["n"].alias("n_at_keep"))
            .filter("group_size > 1").select(*GROUP_COLUMNS))


def marked_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id is kept; of several rows with that id, exactly one. A text that
    occurs once keeps its row. Null ids are smaller than all others."""
    groups = stored(duplicate_groups(docs, id_col, text_col, **options), "dedup-groups")
    text = _text(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
    met = rows.join(groups, ["n_bytes", "text_sha256"], "left")
    is_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    alone = F.col("group_size").isNull()
    plain = met.filter(alone | ~is_keep | (F.col("n_at_keep") == 1)).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), (alone | is_keep).alias("kept"), "text_sha256")
    # rows alike in id and text: as many rows as there were, the first of them kept
    tied = groups.filter("n_at_keep > 1").select(
        F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n_at_keep"))).alias("i"), "text_sha256")
    return plain.unionByName(tied.select("doc_id", "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that may belong to a group of duplicates are joined; all others pass where they are read, and the full
    hash is taken only of rows whose length and prefix are repeated. Of several rows with equal text and the kept id,
    any one stays. A null text counts as empty, null ids are smaller than all others, an empty table gives none; a text
    of any length is hashed where it is read, and columns named like intermediates keep their values."""
    rows = _sized(docs, id_col, text_col)
    refined = _refined(rows, prefix_chars, filter_bits)
    groups = stored(_groups(rows, refined), "dedup-groups")
    members = stored(bit_words(groups.select(_place(filter_bits, "text_sha256").alias("p")), filter_bits), "dedup-bits")
    name, doc = free_name("_sha", docs.columns), F.struct(*[f"`{c}`" for c in docs.columns])
    text = _text(text_col)
    sized = docs.select(doc.alias("doc"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    hashed = sized.select("doc", F.when(refined[0] & refined[1], F.sha2("text", 256)).alias(name))
    maybe = F.col(name).isNotNull() & F.coalesce(bit_at(members.scalar(), _place(filter_bits, name)), F.lit(False))
    found = groups.select(F.col("text_sha256").alias(name), "keep_id", "n_at_keep")
    checked = hashed.filter(maybe).join(found, name, "left").filter(
        F.col("n_at_keep").isNull() | F.col("doc").getField(id_col).eqNullSafe(F.col("keep_id")))
    tied = F.coalesce(F.col("n_at_keep"), F.lit(1)) > 1
    out = hashed.filter(~maybe).select("doc.*")
    out = out.unionByName(checked.filter(~tied).select("doc.*"))
    return out.unionByName(checked.filter(tied).dropDuplicates([name]).select("doc.*"))
