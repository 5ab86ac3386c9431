"""Exact dedup (native): group by a 128-bit content hash and by the bytes themselves, keep one stable id.

Plan. Each text is grouped by (md5 of the normalised text, the text): the hash spreads the rows, and the text in the grouping
key is the comparison of bytes, done where the aggregation compares its keys. Copies meet first inside each map task, so a group
that holds a third of all rows sends one row a task. What remains is one short row a distinct text (no text in it); documents,
reduced to id and hash, are then joined to these short rows. Should two texts share a hash, only the documents of that
hash are joined once more by hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.llm.common import ascii_lower, cut


def _hash(norm: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.md5(norm), 1, bits // 4))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_bits: int = 128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. keep: "min" or "max", the id that
    stays. Null ids: never preferred to an id; a group of null ids only keeps them (keep_id null). Rows that repeat the id that
    stays are all marked kept. An empty table gives an empty result; other columns are ignored. hash_bits is lowered in tests
    only, to force collisions.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", _hash(F.col("norm"), hash_bits))
    best = {"min": F.min, "max": F.max}[keep]
    groups = cut(
        rows.groupBy("h", "norm")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", "keep_id", "group_size", F.sha2(F.col("norm"), 256).alias("text_sha256"))
    )
    per_hash = groups.groupBy("h").agg(
        F.count(F.lit(1)).alias("texts"), *(F.max(c).alias(c) for c in ("keep_id", "group_size", "text_sha256"))
    )
    one = per_hash.where("texts = 1").drop("texts")
    out = rows.select("id", "h").join(one, "h")
    if not groups.groupBy("h").count().where("count > 1").isEmpty():
        several = groups.join(per_hash.where("texts > 1").select("h"), "h", "left_semi").withColumnRenamed("text_sha256", "sha")
        again = rows.join(several.select("h").distinct(), "h", "left_semi").withColumn("sha", F.sha2(F.col("norm"), 256))
        by_text = again.groupBy("h", "norm", "sha").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        more = again.join(by_text, ["h", "norm", "sha"])
        out = out.select("id", "keep_id", "group_size", "text_sha256").unionByName(
            more.select("id", "keep_id", "group_size", F.col("sha").alias("text_sha256"))
        )
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the copies. Ids must be unique here; rows of a null id are kept."""
    gone = exact_groups(docs, id_col, text_col, keep).where(~F.col("kept")).select(id_col)
    return docs.join(gone, id_col, "left_anti")
