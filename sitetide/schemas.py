"""Explicit schemas of the state tables, the landed inputs and the change inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """Schema from ``name type [NOT NULL], ...`` (no session needed)."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


TABLES_DDL = {
    "competitors": """
        id string NOT NULL, name string NOT NULL, domain string NOT NULL, is_enabled boolean NOT NULL,
        baseline_established boolean NOT NULL, last_scan_status string, last_scanned_at timestamp,
        created_at timestamp NOT NULL, updated_at timestamp NOT NULL, deleted_at timestamp""",
    "sitemap_sources": """
        id string NOT NULL, competitor_id string NOT NULL, url string NOT NULL, normalized_url string NOT NULL,
        source_type string NOT NULL, is_enabled boolean NOT NULL, is_discovered boolean NOT NULL,
        parent_source_id string, last_success_at timestamp, last_error string,
        created_at timestamp NOT NULL, updated_at timestamp NOT NULL""",
    "scan_runs": """
        id string NOT NULL, competitor_id string NOT NULL, trigger_type string NOT NULL, status string NOT NULL,
        is_complete boolean NOT NULL, sitemap_count bigint NOT NULL, total_url_count bigint NOT NULL,
        new_count bigint NOT NULL, missing_count bigint NOT NULL, reappeared_count bigint NOT NULL,
        fetch_success_count bigint NOT NULL, fetch_failed_count bigint NOT NULL,
        analysis_success_count bigint NOT NULL, analysis_failed_count bigint NOT NULL,
        error_summary string, started_at timestamp, finished_at timestamp, created_at timestamp NOT NULL""",
    "scan_sitemaps": """
        id string NOT NULL, scan_run_id string NOT NULL, sitemap_source_id string, requested_url string NOT NULL,
        http_status int, result_status string NOT NULL, content_hash string, url_count bigint NOT NULL,
        error_code string, error_message string, started_at timestamp, finished_at timestamp""",
    "pages": """
        id string NOT NULL, competitor_id string NOT NULL, original_url string NOT NULL,
        normalized_url string NOT NULL, current_url string NOT NULL, lifecycle_status string NOT NULL,
        missing_streak int NOT NULL, first_seen_at timestamp NOT NULL, last_seen_at timestamp NOT NULL,
        sitemap_lastmod string, first_scan_run_id string, last_scan_run_id string,
        created_at timestamp NOT NULL, updated_at timestamp NOT NULL, deleted_at timestamp""",
    "page_sitemap_links": """
        page_id string NOT NULL, sitemap_source_id string NOT NULL, first_seen_at timestamp NOT NULL,
        last_seen_at timestamp NOT NULL, is_current boolean NOT NULL, sitemap_lastmod string""",
    "page_events": """
        id string NOT NULL, page_id string NOT NULL, scan_run_id string, event_type string NOT NULL,
        old_value_json string, new_value_json string, detected_at timestamp NOT NULL, created_at timestamp NOT NULL""",
    "page_seo_data": """
        page_id string NOT NULL, http_status int, final_url string, redirect_chain array<string>,
        content_type string, title string, meta_description string, h1 string, h2 array<string>,
        canonical_url string, robots_meta string, page_language string, content_excerpt string,
        content_hash string, fetch_status string NOT NULL, fetch_error string, fetched_at timestamp,
        updated_at timestamp NOT NULL""",
    "fetch_attempts": """
        id string NOT NULL, page_id string NOT NULL, scan_run_id string, trigger_type string NOT NULL,
        attempt_number int NOT NULL, status string NOT NULL, http_status int, error_code string,
        error_message string, duration_ms bigint, started_at timestamp, finished_at timestamp""",
    "page_analyses": """
        id string NOT NULL, page_id string NOT NULL, status string NOT NULL, provider string NOT NULL,
        model string NOT NULL, prompt_version string NOT NULL, page_type string, primary_topic string,
        primary_keyword string, secondary_keywords array<string>, search_intent string, product_line string,
        summary string, evidence array<string>, confidence double, raw_response_excerpt string,
        error_code string, error_message string, analyzed_at timestamp, created_at timestamp NOT NULL""",
    "page_review": """
        page_id string NOT NULL, review_status string NOT NULL, is_viewed boolean NOT NULL,
        is_worth_following boolean NOT NULL, manual_page_type string, manual_primary_keyword string,
        manual_secondary_keywords array<string>, manual_search_intent string, notes string,
        reviewed_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL""",
}

# Landed inputs: what a crawler wrote before the job starts.
LANDED_DDL = {
    "responses": """
        competitor_id string, url string, status int, location string, content_type string,
        content_length string, body string, error string, landed_at timestamp""",
}

TABLES: dict[str, T.StructType] = {name: struct(ddl) for name, ddl in TABLES_DDL.items()}
LANDED: dict[str, T.StructType] = {name: struct(ddl) for name, ddl in LANDED_DDL.items()}

# The closed value sets of the status columns.
ENUMS: dict[tuple[str, str], list[str]] = {
    ("sitemap_sources", "source_type"): ["manual", "robots", "common_path", "sitemap_index_child"],
    ("scan_runs", "trigger_type"): ["cron", "manual", "retry"],
    ("scan_runs", "status"): ["queued", "running", "success", "partial_success", "failed"],
    ("scan_sitemaps", "result_status"): ["pending", "success", "failed", "skipped"],
    ("pages", "lifecycle_status"): ["baseline", "active", "new", "missing", "reappeared"],
    ("page_seo_data", "fetch_status"): ["pending", "fetching", "success", "failed", "unsupported"],
    ("fetch_attempts", "trigger_type"): ["scan", "manual", "retry", "reappeared"],
    ("fetch_attempts", "status"): ["pending", "running", "success", "failed", "unsupported"],
    ("page_analyses", "status"): ["pending", "analyzing", "success", "failed", "skipped"],
    ("page_review", "review_status"): ["unreviewed", "reviewed", "worth_following", "not_relevant"],
}

PRIMARY_KEYS = {name: ["id"] for name in TABLES} | {
    "page_sitemap_links": ["page_id", "sitemap_source_id"],
    "page_seo_data": ["page_id"],
    "page_review": ["page_id"],
}

UNIQUE_KEYS: dict[str, list[tuple[list[str], str | None]]] = {
    "competitors": [(["domain"], "deleted_at IS NULL")],
    "sitemap_sources": [(["competitor_id", "normalized_url"], None)],
    "scan_runs": [(["competitor_id"], "status = 'running'")],
    "pages": [(["competitor_id", "normalized_url"], None)],
}

# (table, column) -> table whose ``id`` it must exist in.
FOREIGN_KEYS = {
    ("sitemap_sources", "competitor_id"): "competitors",
    ("sitemap_sources", "parent_source_id"): "sitemap_sources",
    ("scan_runs", "competitor_id"): "competitors",
    ("scan_sitemaps", "scan_run_id"): "scan_runs",
    ("scan_sitemaps", "sitemap_source_id"): "sitemap_sources",
    ("pages", "competitor_id"): "competitors",
    ("pages", "first_scan_run_id"): "scan_runs",
    ("pages", "last_scan_run_id"): "scan_runs",
    ("page_sitemap_links", "page_id"): "pages",
    ("page_sitemap_links", "sitemap_source_id"): "sitemap_sources",
    ("page_events", "page_id"): "pages",
    ("page_events", "scan_run_id"): "scan_runs",
    ("page_seo_data", "page_id"): "pages",
    ("fetch_attempts", "page_id"): "pages",
    ("fetch_attempts", "scan_run_id"): "scan_runs",
    ("page_analyses", "page_id"): "pages",
    ("page_review", "page_id"): "pages",
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table that Spark knows to be empty before it runs, so that joins with it take no job."""
    return conform(spark.range(1).filter(F.lit(False)), name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``name`` in order and type; columns the input lacks become null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )
