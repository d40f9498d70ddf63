"""Exact duplicates: grouped by a 128-bit content hash, bytes compared inside the groups.

Two texts are equal when they are identical after every run of white space became one space; null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.llm.common import SPACES, text_or_empty


def content(column: str = "text") -> Column:
    """The text that is compared."""
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def _grouped(docs: DataFrame, columns: list[Column]):
    # The hash leads the key, the bytes follow it: unequal texts under one hash stay two groups. Copies are merged
    # before the shuffle, so that a text with a third of all rows arrives as one row a task.
    keyed = docs.select(content().alias("_content"), *columns)
    return keyed.groupBy(F.md5("_content").alias("_hash"), "_content")


def content_groups(docs: DataFrame) -> DataFrame:
    """One row per distinct content: _hash, text_sha256, keep_id (smallest doc_id; null ids only if there is no other), group_size."""
    return _grouped(docs, [F.col("doc_id").alias("_id")]).agg(
        F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
    ).select("_hash", F.sha2(F.col("_content"), 256).alias("text_sha256"), "keep_id", "group_size")


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text is an empty one; a null doc_id is kept only in a group without any other id. Repeated rows of the id
    that stays are all marked as kept (``drop_duplicates`` returns one). Empty and very long texts are texts like others.
    Other columns are ignored; an empty table gives an empty result.

    The texts move once, in the grouping; the join back carries hashes. It is keyed by MD5 and SHA-256 of the bytes, so
    contents that the grouping told apart don't meet again. The few rows of a hot group's key on one side let adaptive
    execution split the other side.
    """
    text = F.col("_content")
    rows = docs.select(F.col("doc_id"), content().alias("_content")).select(
        "doc_id", F.md5(text).alias("_hash"), F.sha2(text, 256).alias("text_sha256"))
    return rows.join(content_groups(docs), ["_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts, with all its columns.

    Ties (repeated ids) go to the smallest of the other columns. Survivors come straight from the grouping: no join, and the
    text is carried a second time only where white space makes it differ from the compared one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = F.col("text").isNotNull() & (F.col("text") == content())
    row = F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), same.alias("same"),
        F.when(~same, F.col("text")).alias("text"), *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)])
    first = _grouped(docs, [row.alias("_row")]).agg(F.min("_row").alias("_row"))
    back = {"doc_id": F.col("_row.doc_id"), "text": F.when(F.col("_row.same"), F.col("_content")).otherwise(F.col("_row.text"))}
    back |= {c: F.col(f"_row.other{i}") for i, c in enumerate(others)}
    return first.select(*[back[c].alias(c) for c in docs.columns])
