"""Current sitemap entries against known pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.operators.joins import join_dimension

KEY = ["competitor_id", "normalized_url"]

NEW = "new"
PRESENT = "present"
FIRST_MISSING = "first_missing"
CONFIRMED_MISSING = "confirmed_missing"
REAPPEARED = "reappeared"

CONFIRM_AFTER = 2


def change_type(seen: Column, known: Column, complete: Column, status: Column, streak: Column) -> Column:
    """Class of one URL; null when the scan does not touch it.

    Never-seen URLs and absences only count in complete scans, sightings of known pages always do.
    """
    missing = status == "missing"
    return (
        F.when(seen & ~known & complete, F.lit(NEW))
        .when(seen & known & missing, F.lit(REAPPEARED))
        .when(seen & known, F.lit(PRESENT))
        .when(~seen & known & complete & ~missing & (streak + 1 >= CONFIRM_AFTER), F.lit(CONFIRMED_MISSING))
        .when(~seen & known & complete & ~missing, F.lit(FIRST_MISSING))
    )


def classify_scan(current: DataFrame, pages: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per known or current URL: page, entry and scan structs plus ``change_type``.

    current: competitor_id, normalized_url, url, lastmod, source_url, one row per key.
    scans: competitor_id, scan_run_id, is_complete, one row per competitor being scanned.
    One full outer join on (competitor_id, normalized_url): the URL in the key spreads even a site that
    holds a large share of all pages, and the scan row is joined with salted keys.
    """
    entries = current.select(*KEY, F.struct("url", "lastmod", "source_url").alias("entry"))
    known = pages.select(*KEY, F.struct(*pages.columns).alias("page"))
    runs = scans.select("competitor_id", F.struct("scan_run_id", "is_complete").alias("scan"))
    joined = join_dimension(
        entries.join(known, KEY, "full_outer"), runs, ["competitor_id"], ["normalized_url"], "left")
    deleted = F.col("page.deleted_at").isNotNull() if "deleted_at" in pages.columns else F.lit(False)
    kind = change_type(
        F.col("entry").isNotNull(),
        F.col("page").isNotNull(),
        F.coalesce(F.col("scan.is_complete"), F.lit(False)),
        F.col("page.lifecycle_status"),
        F.col("page.missing_streak"),
    )
    return joined.withColumn("change_type", F.when(F.col("scan").isNotNull() & ~deleted, kind))


def scan_diff(current: DataFrame, existing: DataFrame, scans: DataFrame) -> DataFrame:
    """Changed URLs only: keys, page_id, url, lastmod, source_url, scan_run_id, change_type."""
    rows = classify_scan(current, existing, scans).filter(F.col("change_type").isNotNull())
    return rows.select(
        *KEY,
        F.col("page.id").alias("page_id"),
        F.col("entry.url").alias("url"),
        F.col("entry.lastmod").alias("lastmod"),
        F.col("entry.source_url").alias("source_url"),
        F.col("scan.scan_run_id").alias("scan_run_id"),
        "change_type",
    )


def split_diff(diff: DataFrame) -> dict[str, DataFrame]:
    """The five disjoint classes as separate frames."""
    return {
        kind: diff.filter(F.col("change_type") == kind)
        for kind in (NEW, PRESENT, FIRST_MISSING, CONFIRMED_MISSING, REAPPEARED)
    }


def diff_counters(diff: DataFrame, keys: list[str]) -> DataFrame:
    return diff.groupBy(*keys).agg(
        F.count_if(F.col("change_type") == NEW).alias("new_count"),
        F.count_if(F.col("change_type") == CONFIRMED_MISSING).alias("missing_count"),
        F.count_if(F.col("change_type") == REAPPEARED).alias("reappeared_count"),
    )


def scan_counters(diff: DataFrame, processed: DataFrame, entries: DataFrame) -> DataFrame:
    """Per competitor: sitemap rows (skipped included), URLs, new, confirmed missing, reappeared."""
    sitemaps = processed.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("sitemap_count"))
    urls = entries.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("total_url_count"))
    names = ["sitemap_count", "total_url_count", "new_count", "missing_count", "reappeared_count"]
    joined = sitemaps.join(urls, "competitor_id", "full_outer").join(
        diff_counters(diff, ["competitor_id"]), "competitor_id", "full_outer")
    return joined.select("competitor_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
