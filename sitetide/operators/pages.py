"""Page list, filters, totals and detail."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.text import contains_pattern, effective
from sitetide.functions.times import moment
from sitetide.operators.joins import join_dimension
from sitetide.operators.reviews import review_defaults
from sitetide.operators.windows import latest_analysis, timeline

DEFAULT_PAGE_SIZE = 20

LIST_COLUMNS = [
    "id", "competitor_id", "competitor_name", "url", "title", "first_seen_at", "lifecycle_status", "fetch_status",
    "analysis_status", "page_type", "primary_keyword", "search_intent", "review_status", "is_viewed",
    "is_worth_following",
]


def discovered_only(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Pages that entered through a ``discovered`` event (baseline pages never show in the list)."""
    found = events.filter(F.col("event_type") == "discovered").select(F.col("page_id").alias("id"))
    return pages.join(found, "id", "left_semi")


def with_latest_analysis(pages: DataFrame, analyses: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Left join with the one analysis that counts per page, its columns in an ``analysis`` struct."""
    names = [c for c in (columns or analyses.columns) if c != "page_id"]
    needed = {"id", "page_id", "status", "analyzed_at", "created_at", *names}
    slim = analyses.select(*[c for c in analyses.columns if c in needed])
    latest = latest_analysis(slim).select(F.col("page_id").alias("id"), F.struct(*names).alias("analysis"))
    return pages.join(latest, "id", "left")


def page_list(
    pages: DataFrame,
    competitors: DataFrame,
    seo: DataFrame,
    review: DataFrame,
    analyses: DataFrame,
    events: DataFrame | None = None,
) -> DataFrame:
    """One row per listed page with effective (manual over inferred) values.

    All joins but the competitor one are on the page id, so Spark can keep one partitioning through
    the chain. ``events`` restricts the list to discovered pages.
    """
    rows = pages.filter("deleted_at IS NULL").select(
        "id", "competitor_id", F.col("current_url").alias("url"), "first_seen_at", "lifecycle_status")
    if events is not None:
        rows = discovered_only(rows, events)
    rows = rows.join(seo.select(F.col("page_id").alias("id"), "title", "fetch_status"), "id", "left")
    rows = rows.join(
        review.select(F.col("page_id").alias("id"), "review_status", "is_viewed", "is_worth_following",
                      "manual_page_type", "manual_primary_keyword", "manual_search_intent"), "id", "left")
    rows = with_latest_analysis(rows, analyses, ["status", "page_type", "primary_keyword", "search_intent"])
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    rows = join_dimension(rows, names, ["competitor_id"], ["id"])
    return review_defaults(
        rows.withColumns(
            {
                "analysis_status": F.col("analysis.status"),
                "page_type": effective("manual_page_type", "analysis.page_type"),
                "primary_keyword": effective("manual_primary_keyword", "analysis.primary_keyword"),
                "search_intent": effective("manual_search_intent", "analysis.search_intent"),
            }
        )
    ).select(*LIST_COLUMNS)


def filter_pages(
    rows: DataFrame,
    competitor_id: str | None = None,
    page_type: str | None = None,
    search_intent: str | None = None,
    review_status: str | None = None,
    query: str | None = None,
    date_from: datetime | str | None = None,
    date_to: datetime | str | None = None,
) -> DataFrame:
    """Only the given filters apply; an absent or empty one is no predicate."""
    predicates: list[Column] = []
    equal = {"competitor_id": competitor_id, "page_type": page_type, "search_intent": search_intent,
             "review_status": review_status}
    predicates += [F.col(name) == value for name, value in equal.items() if value]
    if date_from:
        predicates.append(F.col("first_seen_at") >= moment(date_from))
    if date_to:
        predicates.append(F.col("first_seen_at") <= moment(date_to))
    if query and query.strip():
        predicates.append(
            contains_pattern("url", query)
            | F.coalesce(contains_pattern("title", query), F.lit(False))
            | contains_pattern(F.coalesce("primary_keyword", F.lit("")), query))
    for predicate in predicates:
        rows = rows.filter(predicate)
    return rows


def list_order() -> list[Column]:
    return [F.col("first_seen_at").desc(), F.col("id").desc()]


class Cursor(NamedTuple):
    """Where a page of the list ends: its last row's place in the order."""

    first_seen_at: datetime
    id: str


def next_page(rows: DataFrame, after: Cursor | None = None, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The first ``page_size`` rows behind a cursor; every page costs the same.

    The time bound stands alone as well, so that it reaches the scan of the pages.
    """
    if after is not None:
        at, key = F.lit(after.first_seen_at), F.lit(after.id)
        rows = rows.filter(F.col("first_seen_at") <= at).filter((F.col("first_seen_at") < at) | (F.col("id") < key))
    return rows.orderBy(*list_order()).limit(page_size)


def cursor_of(page: DataFrame) -> Cursor | None:
    """The cursor of a page's end, None for an empty page."""
    last = page.agg(F.min(F.struct("first_seen_at", "id")).alias("last")).first()["last"]
    return last and Cursor(last["first_seen_at"], last["id"])


def paginate(rows: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A page by its number. Days that lie before it are counted, and only the days that it touches are put in order."""
    skip = (max(1, page) - 1) * page_size
    if not skip:
        return next_page(rows, None, page_size)
    day = F.date_trunc("day", "first_seen_at")
    later = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    touched = days.filter((F.col("_before") < skip + page_size) & (F.col("_before") + F.col("_n") > skip)).agg(
        F.min("_day").alias("low"), F.max("_day").alias("high"), F.min("_before").alias("before")).first()
    if touched["low"] is None:
        return rows.limit(0)
    end = F.lit(touched["high"]) + F.expr("INTERVAL 1 DAY")
    listed = rows.filter((F.col("first_seen_at") >= F.lit(touched["low"])) & (F.col("first_seen_at") < end))
    return listed.orderBy(*list_order()).offset(skip - touched["before"]).limit(page_size)


def count_pages(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


DETAIL_SEO = [
    "http_status", "final_url", "redirect_chain", "content_type", "title", "meta_description", "h1", "h2",
    "canonical_url", "robots_meta", "page_language", "content_excerpt", "fetch_status", "fetch_error", "fetched_at",
]
DETAIL_ANALYSIS = [
    "status", "provider", "model", "prompt_version", "page_type", "primary_topic", "primary_keyword",
    "secondary_keywords", "search_intent", "product_line", "summary", "evidence", "confidence", "error_message",
    "analyzed_at",
]
DETAIL_REVIEW = [
    "review_status", "is_viewed", "is_worth_following", "manual_page_type", "manual_primary_keyword",
    "manual_secondary_keywords", "manual_search_intent", "notes", "reviewed_at",
]
LIST_FIELDS = {"redirect_chain", "h2", "secondary_keywords", "evidence", "manual_secondary_keywords"}


def page_detail(state: dict[str, DataFrame], page_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(detail, timeline) of one page, or of all pages when no id is given.

    The id filter is put on every input before the joins, so it reaches each scan.
    """

    def of_page(df: DataFrame, column: str) -> DataFrame:
        return df if page_id is None else df.filter(F.col(column) == page_id)

    def block(df: DataFrame, names: list[str], alias: str) -> DataFrame:
        return of_page(df, "page_id").select(F.col("page_id").alias("id"), F.struct(*names).alias(alias))

    pages = of_page(state["pages"].filter("deleted_at IS NULL"), "id").select(
        "id", "competitor_id", "original_url", "normalized_url", "current_url", "lifecycle_status", "first_seen_at",
        "last_seen_at", "sitemap_lastmod")
    rows = pages.join(block(state["page_seo_data"], DETAIL_SEO, "seo"), "id", "left")
    rows = with_latest_analysis(rows, of_page(state["page_analyses"], "page_id"), DETAIL_ANALYSIS)
    rows = rows.join(block(state["page_review"], DETAIL_REVIEW, "review"), "id", "left")
    names = state["competitors"].select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    rows = join_dimension(rows, names, ["competitor_id"], ["id"])

    def filled(block_name: str, names: list[str]) -> Column:
        defaults = {"review_status": F.lit("unreviewed"), "is_viewed": F.lit(False), "is_worth_following": F.lit(False)}
        defaults |= {name: F.array().cast("array<string>") for name in LIST_FIELDS}
        fields = [
            (F.coalesce(F.col(f"{block_name}.{n}"), defaults[n]) if n in defaults else F.col(f"{block_name}.{n}")).alias(n)
            for n in names
        ]
        return F.struct(*fields)

    detail = rows.withColumns(
        {
            "seo": filled("seo", DETAIL_SEO),
            "analysis": filled("analysis", DETAIL_ANALYSIS),
            "review": filled("review", DETAIL_REVIEW),
        }
    )
    events = timeline(of_page(state["page_events"], "page_id")).select(
        "id", "page_id", "event_type", "old_value_json", "new_value_json", "detected_at")
    return detail, events
