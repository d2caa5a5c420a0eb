"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside groups.

Two documents are equal when their texts are identical after each run of ASCII white
space became one space. Only built-in expressions are used.

Defined results: a null text counts as empty; a null id ranks after all others, and a
group of null ids alone keeps them all; rows that repeat an id and its text are each
counted and share one decision. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.tables import SPACES, text_or_empty
from gapline.runtime import cut_lineage


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per distinct text: content_key, text_sha256, keep_id, group_size.

    The grouping key is the hash and the text itself, so the aggregate compares the
    bytes of texts that share a hash and a collision makes two groups. Each task
    combines its copies first; a text leaves a task once, however often it occurs.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), normalised(text_col).alias("body"))
    return (
        rows.withColumn("content_key", hashed(F.col("body")))
        .groupBy("content_key", "body")
        .agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content_key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Documents meet their group by hash and SHA-256 of the text, with adaptive
    splitting of a hot group: no text moves in this join.
    """
    groups = cut_lineage(content_groups(docs, id_col, text_col, hashed))
    body = docs.select(F.col(id_col).alias("row_id"), normalised(text_col).alias("body"))
    rows = body.select("row_id", hashed(F.col("body")).alias("content_key"), F.sha2("body", 256).alias("text_sha256"))
    return rows.join(groups, ["content_key", "text_sha256"]).select(
        F.col("row_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """The documents that stay, with all their columns; a repeated row stays once.

    One survivor per distinct text is chosen inside the aggregate, as the row with the
    smallest id (other columns break ties), so kept texts need no second read.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), normalised(text_col).alias("body"))
    first = F.min_by("row", F.struct(F.col("row_id").isNull(), "row_id", F.xxhash64("row")))
    kept = rows.withColumn("content_key", hashed(F.col("body"))).groupBy("content_key", "body").agg(first.alias("row"))
    return kept.select("row.*")
