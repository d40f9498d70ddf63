"""Configured and discovered sitemap sources, and the per-scan sitemap log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import make_id
from sitetide.functions.urls import normalize_url
from sitetide.operators.joins import join_dimension
from sitetide.operators.lifecycle import attach_source_id
from sitetide.operators.merge import insert_or_ignore
from sitetide.operators.windows import first_wins, placed
from sitetide.schemas import conform

KEY = ["competitor_id", "normalized_url"]


def source_id() -> Column:
    return make_id("smp", "competitor_id", "normalized_url")


def enabled(df: DataFrame) -> DataFrame:
    return df.filter("is_enabled")


def manual_urls(sources: DataFrame) -> DataFrame:
    """Enabled manual sitemap URLs in the order they were added."""
    rows = enabled(sources).filter(F.col("source_type") == "manual")
    return rows.select("competitor_id", "url", "created_at").orderBy("competitor_id", "created_at", "url")


def seed_order(sources: DataFrame) -> DataFrame:
    """Enabled sources with their 0-based traversal position (source type, creation time, id).

    All sources are put in one order by sampled bounds, in which a site's sources follow each other; a site with very many
    spans several partitions, even if all of them were created at one moment.
    """
    ordered = placed(enabled(sources).orderBy("competitor_id", "source_type", "created_at", "id"), "_place")
    first = ordered.groupBy("competitor_id").agg(F.min("_place").alias("_first"))
    return join_dimension(ordered, first, ["competitor_id"], ["id"]).withColumn("seed_order", F.col("_place") - F.col("_first")).drop("_place", "_first")


def sources_of_scan(scans: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of the competitor each scan belongs to; ``scans`` holds one scan per competitor."""
    runs = scans.select(F.col("id").alias("scan_run_id"), "competitor_id")
    listed = sources.select("competitor_id", F.col("id").alias("source_id"), "normalized_url")
    return join_dimension(listed, runs, ["competitor_id"], ["source_id"])


def attach_parent(children: DataFrame, sources: DataFrame) -> DataFrame:
    """``parent_source_id`` by normalized parent URL: known enabled sources or siblings of the same batch."""
    known = enabled(sources).select("competitor_id", F.col("normalized_url").alias("_key"), F.col("id").alias("_known"))
    siblings = children.select(
        "competitor_id", F.col("normalized_url").alias("_key"), F.col("id").alias("_sibling")).distinct()
    keyed = children.withColumn("_key", normalize_url("parent_url"))
    joined = keyed.join(known, ["competitor_id", "_key"], "left").join(siblings, ["competitor_id", "_key"], "left")
    return joined.withColumn("parent_source_id", F.coalesce("_known", "_sibling")).drop("_key", "_known", "_sibling")


def add_child_sources(sources: DataFrame, children: DataFrame, as_of: Column) -> DataFrame:
    """Store discovered children once, with their parent; known keys are left alone.

    children: competitor_id, path, url, normalized_url, parent_url (first in traversal order wins).
    """
    distinct = first_wins(children, KEY, [F.col("path").asc()])
    fresh = distinct.join(sources.select(*KEY), KEY, "left_anti").withColumn("id", source_id())
    rows = attach_parent(fresh, sources).select(
        "*",
        F.lit("sitemap_index_child").alias("source_type"),
        F.lit(True).alias("is_enabled"),
        F.lit(True).alias("is_discovered"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return sources.unionByName(conform(rows, "sitemap_sources"))


def add_root_sources(sources: DataFrame, roots: DataFrame, as_of: Column) -> DataFrame:
    """Store discovered roots (competitor_id, normalized_url, url, source_type); known keys stay."""
    rows = roots.select(
        source_id().alias("id"),
        "competitor_id",
        "url",
        "normalized_url",
        "source_type",
        F.lit(True).alias("is_enabled"),
        F.lit(True).alias("is_discovered"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return insert_or_ignore(sources, conform(rows, "sitemap_sources"), KEY)


def record_processed(processed: DataFrame, sources: DataFrame, scans: DataFrame, as_of: Column) -> DataFrame:
    """Sitemap log rows of the processed documents; ``scans`` gives scan_run_id per competitor."""
    rows = join_dimension(processed, scans.select("competitor_id", "scan_run_id"), ["competitor_id"], ["path"])
    rows = attach_source_id(rows, sources, url="url", explicit="source_id", spread="path")
    return conform(
        rows.select(
            make_id("ssm", "scan_run_id", "path").alias("id"),
            "scan_run_id",
            "sitemap_source_id",
            F.col("url").alias("requested_url"),
            "http_status",
            F.col("status").alias("result_status"),
            "content_hash",
            "url_count",
            "error_code",
            "error_message",
            as_of.alias("started_at"),
            as_of.alias("finished_at"),
        ),
        "scan_sitemaps",
    )
