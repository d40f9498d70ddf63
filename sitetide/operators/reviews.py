"""Analyst reviews of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import empty_to_null
from sitetide.operators.merge import merge_by_key, take

WRITTEN = [
    "review_status", "is_viewed", "is_worth_following", "manual_page_type", "manual_primary_keyword",
    "manual_secondary_keywords", "manual_search_intent", "notes",
]
FREE_TEXT = ["manual_page_type", "manual_primary_keyword", "manual_search_intent", "notes"]


def upsert_review(review: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Reviews after changes (page_id and all written fields): everything is overwritten but created_at."""
    cleaned = changes.withColumns({name: empty_to_null(name) for name in FREE_TEXT}).select(
        "page_id", *WRITTEN, as_of.alias("reviewed_at"), as_of.alias("created_at"), as_of.alias("updated_at"))
    return merge_by_key(
        review, cleaned, ["page_id"], matched={n: take(n) for n in [*WRITTEN, "reviewed_at", "updated_at"]})


def review_defaults(df: DataFrame) -> DataFrame:
    """Pages nobody reviewed count as unreviewed, not viewed and not worth following."""
    return df.withColumns(
        {
            "review_status": F.coalesce("review_status", F.lit("unreviewed")),
            "is_viewed": F.coalesce("is_viewed", F.lit(False)),
            "is_worth_following": F.coalesce("is_worth_following", F.lit(False)),
        }
    )
