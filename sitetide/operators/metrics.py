"""Dashboard numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.times import RECENT_WINDOW, ago, shanghai_day_start, utc_day_start

from sitetide.operators.joins import join_dimension


def metrics_events(events: DataFrame, as_of: Column) -> DataFrame:
    """New pages by ``discovered`` events: since the business day began, since seven days."""
    return events.filter(F.col("event_type") == "discovered").agg(
        F.count_if(F.col("detected_at") >= shanghai_day_start(as_of)).alias("today_new"),
        F.count_if(F.col("detected_at") >= ago(as_of, RECENT_WINDOW)).alias("seven_day_new"),
    )


def active_pages(pages: DataFrame, competitors: DataFrame) -> DataFrame:
    """Non-deleted pages of non-deleted competitors."""
    active = competitors.filter("deleted_at IS NULL").select(F.col("id").alias("competitor_id"))
    return join_dimension(pages.filter("deleted_at IS NULL"), active, ["competitor_id"], ["id"], "left_semi")


def metrics_status(pages: DataFrame, competitors: DataFrame, as_of: Column) -> DataFrame:
    """New pages by status: ``new`` since UTC midnight, ``new`` or ``active`` since seven days."""
    seen, status = F.col("first_seen_at"), F.col("lifecycle_status")
    return active_pages(pages, competitors).agg(
        F.count_if((seen >= utc_day_start(as_of)) & (status == "new")).alias("today_new"),
        F.count_if((seen >= ago(as_of, RECENT_WINDOW)) & status.isin("new", "active")).alias("seven_day_new"),
    )


def metrics_review(review: DataFrame, pages: DataFrame | None = None, competitors: DataFrame | None = None) -> DataFrame:
    """Unreviewed and worth-following counts, over all reviews or those of active pages only."""
    rows = review
    if pages is not None and competitors is not None:
        ids = active_pages(pages, competitors).select(F.col("id").alias("page_id"))
        rows = review.join(ids, "page_id", "left_semi")
    return rows.agg(
        F.count_if(F.col("review_status") == "unreviewed").alias("unreviewed"),
        F.count_if(F.col("is_worth_following")).alias("worth_following"),
    )
