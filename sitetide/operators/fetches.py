"""Page fetch outcomes and their effect on the SEO snapshot, pages, events and the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.html import SEO_FIELDS, blank_seo, extract_seo
from sitetide.functions.jsons import safe_json
from sitetide.functions.text import EXCERPT_CHARS, clip, make_id
from sitetide.operators.joins import join_hot
from sitetide.operators.lifecycle import append_events, new_events
from sitetide.operators.merge import merge_by_key, take
from sitetide.operators.redirects import LIMIT_CODE
from sitetide.schemas import conform
from sitetide.session import cut_lineage
from sitetide.sources.tables import size_error, too_large

# Fixed value: the page size that a live crawler accepts.
PAGE_MAX_BYTES = 1_500_000
TIMEOUT_ERRORS = ["RESPONSE_BODY_TIMEOUT", "AbortError", "TimeoutError"]
# Fixed value: the error that can only follow an accepted status and content type.
BODY_TIMEOUT = "RESPONSE_BODY_TIMEOUT"


def fetch_outcome(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Append ``fetch_status``, ``code``, ``message`` and ``http_status``.

    Expects status, content_type, content_length, body, error, error_code (from ``resolve_redirects``,
    or null). Order of the checks: transport and redirects, HTTP status, content type, reading the body, size.
    """
    status, kind = F.col("status"), F.col("content_type")
    reading = F.coalesce(F.coalesce("error_code", "error") == BODY_TIMEOUT, F.lit(False))
    transport = F.col("error").isNotNull() & ~reading
    http_error = ~F.coalesce(status.between(200, 299), F.lit(False))
    unsupported = ~F.coalesce(F.contains(F.lower(kind), F.lit("text/html")), F.lit(False))
    large = too_large("body", "content_length", max_bytes)
    code = (
        F.when(transport & (F.col("error_code") == LIMIT_CODE), F.lit("PAGE_REDIRECT_LIMIT"))
        .when(transport & F.coalesce("error_code", "error").isin(TIMEOUT_ERRORS), F.lit("PAGE_FETCH_TIMEOUT"))
        .when(transport, F.lit("PAGE_FETCH_FAILED"))
        .when(http_error, F.lit("PAGE_HTTP_ERROR"))
        .when(unsupported, F.lit("PAGE_UNSUPPORTED_CONTENT_TYPE"))
        .when(reading, F.lit("PAGE_FETCH_TIMEOUT"))
        .when(large, F.lit("PAGE_RESPONSE_TOO_LARGE"))
    )
    message = (
        F.when(transport, F.col("error"))
        .when(http_error, F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("0"))))
        .when(unsupported & (F.length(kind) > 0), F.concat(F.lit("Unsupported content type: "), kind))
        .when(unsupported, F.lit("Missing content type"))
        .when(reading, F.col("error"))
        .when(large, F.lit(size_error(max_bytes)))
    )
    return responses.withColumns({"code": code, "message": message}).withColumns(
        {
            "fetch_status": F.when(F.col("code").isNull(), F.lit("success"))
            .when(F.col("code") == "PAGE_UNSUPPORTED_CONTENT_TYPE", F.lit("unsupported"))
            .otherwise(F.lit("failed")),
            "http_status": F.when(
                F.col("code").isNull()
                | F.col("code").isin("PAGE_HTTP_ERROR", "PAGE_UNSUPPORTED_CONTENT_TYPE", "PAGE_REDIRECT_LIMIT"),
                status,
            ),
        }
    )


def fetch_results(
    fetched: DataFrame, max_bytes: int | None = None, max_excerpt_chars: int | None = None, max_h2: int | None = None
) -> DataFrame:
    """Full result rows: outcome, SEO fields on success, blanks otherwise.

    Only bodies of successful fetches reach the HTML expressions.
    """
    outcome = fetch_outcome(fetched, max_bytes)
    body = F.when(F.col("fetch_status") == "success", F.col("body"))
    seo = extract_seo(outcome.withColumn("body", body), "body", "final_url", max_excerpt_chars, max_h2).drop("body")
    broken = (F.col("fetch_status") == "success") & F.col("seo_error").isNotNull()
    settled = seo.withColumns(
        {
            "code": F.when(broken, F.lit("PAGE_FETCH_FAILED")).otherwise(F.col("code")),
            "message": F.when(broken, F.col("seo_error")).otherwise(F.col("message")),
            "http_status": F.when(~broken, F.col("http_status")),
            "fetch_status": F.when(broken, F.lit("failed")).otherwise(F.col("fetch_status")),
        }
    ).drop("seo_error")
    keeps_type = F.col("fetch_status").isin("success", "unsupported")
    return blank_seo(settled, F.col("fetch_status") == "success").withColumn(
        "content_type", F.when(keeps_type, F.col("content_type")))


ON_ANY_RESULT = ["http_status", "final_url", "redirect_chain", "content_type"]


def upsert_fetch(seo: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """SEO snapshot after fetch results (page_id first). A failure keeps the earlier SEO text."""
    changes = results.select(
        "page_id",
        *ON_ANY_RESULT,
        *SEO_FIELDS,
        "fetch_status",
        F.when(F.col("fetch_status") != "success", F.col("message")).alias("fetch_error"),
        as_of.alias("fetched_at"),
        as_of.alias("updated_at"),
    )
    always = {n: take(n) for n in [*ON_ANY_RESULT, "fetch_status", "fetch_error", "fetched_at", "updated_at"]}

    def on_success(name: str):
        return lambda old, new: F.when(new["fetch_status"] == "success", new[name]).otherwise(old[name])

    return merge_by_key(seo, changes, ["page_id"], matched=always | {n: on_success(n) for n in SEO_FIELDS})


def apply_redirects(pages: DataFrame, results: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(pages, events) after successful fetches that ended somewhere else."""
    moved = results.filter((F.col("fetch_status") == "success") & (F.size("redirect_chain") > 0))
    changes = moved.select(F.col("page_id").alias("id"), "final_url")
    after = merge_by_key(
        pages, changes, ["id"], insert=False,
        matched={"current_url": take("final_url"), "updated_at": lambda o, n: as_of})
    events = new_events(
        moved, F.col("page_id"), F.lit(None).cast("string"), F.lit("redirected"), as_of,
        safe_json(finalUrl=F.col("final_url"), chain=F.col("redirect_chain")))
    return after, events


def failure_events(results: DataFrame, as_of: Column) -> DataFrame:
    failed = results.filter(F.col("fetch_status") != "success")
    return new_events(
        failed, F.col("page_id"), F.lit(None).cast("string"), F.lit("fetch_failed"), as_of,
        safe_json(code=F.col("code"), message=F.col("message")))


def fetch_log(results: DataFrame, as_of: Column) -> DataFrame:
    """Fetch-attempt rows with their final values (needs page_id, scan_run_id, optional duration_ms)."""
    duration = F.col("duration_ms") if "duration_ms" in results.columns else F.lit(None)
    return conform(
        results.select(
            make_id("fetch", "scan_run_id", "page_id").alias("id"),
            "page_id",
            "scan_run_id",
            F.lit("scan").alias("trigger_type"),
            F.lit(1).alias("attempt_number"),
            F.col("fetch_status").alias("status"),
            "http_status",
            F.col("code").alias("error_code"),
            F.col("message").alias("error_message"),
            duration.alias("duration_ms"),
            as_of.alias("started_at"),
            as_of.alias("finished_at"),
        ),
        "fetch_attempts",
    )


def fetch_targets(ids: DataFrame, pages: DataFrame, competitors: DataFrame) -> DataFrame:
    """(page_id, competitor_id, url, domain) of the pages to fetch; there may be as many competitors as pages."""
    wanted = cut_lineage(pages.select(F.col("id").alias("page_id"), "competitor_id", F.col("current_url").alias("url")).join(
        ids.select("page_id"), "page_id", "left_semi"))
    domains = competitors.select(F.col("id").alias("competitor_id"), "domain")
    return join_hot(wanted, domains, ["competitor_id"], ["page_id"])


def save_fetches(state: dict[str, DataFrame], results: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """State after a batch of fetch results."""
    pages, moved = apply_redirects(state["pages"], results, as_of)
    return state | {
        "pages": pages,
        "page_seo_data": upsert_fetch(state["page_seo_data"], results, as_of),
        "page_events": append_events(state["page_events"], moved, failure_events(results, as_of)),
        "fetch_attempts": state["fetch_attempts"].unionByName(fetch_log(results, as_of)),
    }


def clip_excerpts(seo: DataFrame, n: int = EXCERPT_CHARS) -> DataFrame:
    """Shorten stored excerpts that are longer than the policy allows."""
    long = F.length("content_excerpt") > n
    return seo.withColumn(
        "content_excerpt", F.when(long, clip("content_excerpt", n)).otherwise(F.col("content_excerpt")))
