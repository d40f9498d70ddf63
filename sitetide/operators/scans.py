"""Opening, closing and summarizing scan runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import clip, error_line, make_id
from sitetide.functions.times import STALE_AFTER, ago
from sitetide.operators.merge import merge_by_key, take
from sitetide.operators.traversal import first_lines
from sitetide.operators.windows import top_rows
from sitetide.schemas import conform

STALE_MESSAGE = "Recovered stale running scan"
SUPERSEDED_MESSAGE = "Superseded duplicate running scan during migration"
BASELINE_INCOMPLETE = "Initial baseline scan was incomplete"
ALREADY_RUNNING = "SCAN_ALREADY_RUNNING"

# A line has at least one URL character, ': ', one message character and the line break.
_SHORTEST_LINE = 5


def fail_stale(scan_runs: DataFrame, requests: DataFrame | None, as_of: Column) -> DataFrame:
    """Runs still running after six hours become failed (only of requesting competitors, if given)."""
    stale = (F.col("status") == "running") & (F.col("started_at") < ago(as_of, STALE_AFTER))
    rows = scan_runs
    if requests is not None:
        asked = requests.select("competitor_id").distinct().withColumn("_asked", F.lit(True))
        rows = rows.join(asked, "competitor_id", "left")
        stale = stale & F.coalesce(F.col("_asked"), F.lit(False))
    return rows.withColumns(
        {
            "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
            "is_complete": F.when(stale, F.lit(False)).otherwise(F.col("is_complete")),
            "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")),
            "error_summary": F.when(stale, F.coalesce("error_summary", F.lit(STALE_MESSAGE))).otherwise(
                F.col("error_summary")),
        }
    ).select(*scan_runs.columns)


def open_scans(scan_runs: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan_runs, opened, rejects) for requests (competitor_id, trigger_type).

    A competitor that still has a running row is refused; stale rows are recovered first.
    """
    swept = fail_stale(scan_runs, requests, as_of)
    running = swept.filter(F.col("status") == "running").groupBy("competitor_id").agg(
        F.min("id").alias("running_id"))
    asked = requests.groupBy("competitor_id").agg(F.min("trigger_type").alias("trigger_type"))
    checked = asked.join(running, "competitor_id", "left")
    counts = [
        "sitemap_count", "total_url_count", "new_count", "missing_count", "reappeared_count",
        "fetch_success_count", "fetch_failed_count", "analysis_success_count", "analysis_failed_count",
    ]
    opened = conform(
        checked.filter(F.col("running_id").isNull()).select(
            make_id("scan", "competitor_id", as_of.cast("string")).alias("id"),
            "competitor_id",
            "trigger_type",
            F.lit("running").alias("status"),
            F.lit(False).alias("is_complete"),
            *[F.lit(0).alias(c) for c in counts],
            as_of.alias("started_at"),
            as_of.alias("created_at"),
        ),
        "scan_runs",
    )
    rejects = checked.filter(F.col("running_id").isNotNull()).select(
        "competitor_id", F.lit(ALREADY_RUNNING).alias("code"), F.col("running_id").alias("scan_run_id"))
    return swept.unionByName(opened), opened, rejects


def superseded_runs(scan_runs: DataFrame) -> DataFrame:
    """Running rows with a newer running row (created_at, id) of the same competitor.

    Only the newest row per competitor is aggregated, then each running row is compared with it.
    """
    running = scan_runs.filter(F.col("status") == "running")
    newest = running.groupBy("competitor_id").agg(F.max(F.struct("created_at", "id")).alias("_newest"))
    return running.join(newest, "competitor_id").filter(F.col("id") != F.col("_newest.id")).drop("_newest").select(
        *scan_runs.columns)


def fail_superseded(scan_runs: DataFrame, as_of: Column) -> DataFrame:
    changes = superseded_runs(scan_runs).select("id")
    return merge_by_key(
        scan_runs, changes, ["id"], insert=False,
        matched={
            "status": lambda o, n: F.lit("failed"),
            "is_complete": lambda o, n: F.lit(False),
            "finished_at": lambda o, n: F.coalesce(o["finished_at"], as_of),
            "error_summary": lambda o, n: F.coalesce(o["error_summary"], F.lit(SUPERSEDED_MESSAGE)),
        },
    )


def error_summary(processed: DataFrame, keys: list[str], max_chars: int | None = None) -> DataFrame:
    """Newline-joined error lines of the failed sitemaps in walk order, one text a scan; clipped with ``max_chars``.

    Every line takes at least five characters, so the first max_chars / 5 lines decide a clipped text and
    no more are gathered per scan.
    """
    n = None if max_chars is None else -(-max_chars // _SHORTEST_LINE)
    lines = first_lines(processed, keys, n).select(
        *keys, "path", error_line("url", "error_message", "error_code").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "line")))
    joined = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
    return lines.groupBy(*keys).agg(clip(joined, max_chars).alias("error_summary"))


def scan_status(baseline_established: Column, is_complete: Column) -> Column:
    return (
        F.when(is_complete, F.lit("success"))
        .when(baseline_established, F.lit("partial_success"))
        .otherwise(F.lit("failed"))
    )


CLOSING = [
    "status", "is_complete", "sitemap_count", "total_url_count", "new_count", "missing_count", "reappeared_count",
    "error_summary",
]


def close_scans(
    scan_runs: DataFrame, competitors: DataFrame, results: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Write results (scan_run_id, competitor_id and the closing columns) to both tables; of several runs of one competitor the
    one with the largest id gives the competitor's last status."""
    rules = {name: take(name) for name in CLOSING} | {"finished_at": lambda o, n: as_of}
    changes = results.select(F.col("scan_run_id").alias("id"), *CLOSING)
    runs = merge_by_key(scan_runs, changes, ["id"], matched=rules, insert=False)
    touched = results.groupBy(F.col("competitor_id").alias("id")).agg(F.max_by("status", "scan_run_id").alias("status"))
    sites = merge_by_key(
        competitors, touched, ["id"], insert=False,
        matched={
            "last_scan_status": take("status"),
            "last_scanned_at": lambda o, n: as_of,
            "updated_at": lambda o, n: as_of,
        },
    )
    return runs, sites


def fail_scans(
    scan_runs: DataFrame, competitors: DataFrame, failures: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Close scans that broke (scan_run_id, competitor_id, message): failed, all counts zero."""
    zero = {name: F.lit(0).cast("bigint") for name in CLOSING if name.endswith("_count")}
    results = failures.withColumns(
        zero | {
            "status": F.lit("failed"),
            "is_complete": F.lit(False),
            "error_summary": F.coalesce("message", F.lit("Unknown scan error")),
        }
    )
    return close_scans(scan_runs, competitors, results, as_of)


def write_pipeline_counts(scan_runs: DataFrame, counters: DataFrame) -> DataFrame:
    names = [c for c in counters.columns if c.endswith("_count")]
    changes = counters.withColumnRenamed("scan_run_id", "id")
    return merge_by_key(scan_runs, changes, ["id"], matched={n: take(n) for n in names}, insert=False)


RECENT_COLUMNS = [
    "id", "competitor_name", "status", "total_url_count", "new_count", "missing_count", "reappeared_count",
    "started_at", "finished_at",
]


def recent_scans(scan_runs: DataFrame, competitors: DataFrame, active_only: bool = False, n: int = 10) -> DataFrame:
    """The most recent scans with the competitor name; optionally of non-deleted competitors only."""
    names = competitors.filter("deleted_at IS NULL") if active_only else competitors
    names = names.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"))
    return top_scans(scan_runs.join(names, "competitor_id"), n).select(*RECENT_COLUMNS)


def top_scans(scan_runs: DataFrame, n: int = 10) -> DataFrame:
    return scan_runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def latest_scans(scan_runs: DataFrame, n: int = 1) -> DataFrame:
    return top_rows(scan_runs, ["competitor_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def run_summary(summaries: DataFrame) -> DataFrame:
    """One row: scans completed and new pages over all competitors."""
    return summaries.agg(
        F.count(F.lit(1)).alias("scanned_competitors"),
        F.coalesce(F.sum("new_count"), F.lit(0)).cast("bigint").alias("new_pages"),
    )
