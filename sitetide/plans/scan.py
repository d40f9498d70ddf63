"""Whole scans as one job over any number of competitors."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.times import moment
from sitetide.operators import diff as D
from sitetide.operators.analysis import (
    PIPELINE_COUNTS,
    Provider,
    analysis_input,
    analysis_outcomes,
    analyze,
    append_analyses,
    pipeline_counters,
)
from sitetide.operators.competitors import not_deleted
from sitetide.operators.fetches import fetch_results, fetch_targets, save_fetches
from sitetide.operators.joins import join_dimension
from sitetide.operators.lifecycle import apply_diff, establish_baseline, page_id
from sitetide.operators.redirects import resolve_redirects
from sitetide.operators.scans import (
    BASELINE_INCOMPLETE,
    close_scans,
    error_summary,
    open_scans,
    scan_status,
    write_pipeline_counts,
)
from sitetide.operators.sitemap_sources import (
    add_child_sources,
    add_root_sources,
    enabled,
    record_processed,
    seed_order,
)
from sitetide.operators.traversal import Limits, expand_sitemaps, scan_complete
from sitetide.session import cut_lineage, write_down
from sitetide.sources.sitemaps import COMMON_PATHS, parse_robots, probe_common_paths, root_candidates

State = dict[str, DataFrame]
Landed = dict[str, DataFrame]

NOT_ENABLED = "COMPETITOR_NOT_ENABLED"
NO_SITEMAP = "NO_SITEMAP"


class ScanResult(NamedTuple):
    state: State
    summaries: DataFrame
    rejects: DataFrame


def discover_roots(
    competitors: DataFrame, sources: DataFrame, landed_roots: DataFrame, robots_bytes: int | None = None,
    preview_bytes: int | None = None,
) -> DataFrame:
    """Sitemap roots (competitor_id, normalized_url, url, source_type, root_order) of competitors without an
    enabled source, from their robots.txt and the common paths; larger responses are passed over where a size is given."""
    known = enabled(sources).select(F.col("competitor_id").alias("id"))
    bare = competitors.join(known, "id", "left_anti").select(F.col("id").alias("competitor_id"), "domain")
    paths = F.array(F.lit("/robots.txt"), *[F.lit(p) for p in COMMON_PATHS])
    requests = bare.select("competitor_id", "domain", F.explode(paths).alias("path")).select(
        "competitor_id", "domain", F.concat(F.lit("https://"), "domain", "path").alias("url"))
    fetched = resolve_redirects(requests, landed_roots)
    robots = parse_robots(fetched.filter(F.endswith("url", F.lit("/robots.txt"))), robots_bytes)
    return root_candidates(robots, probe_common_paths(bare, fetched, preview_bytes))


def process_new_pages(
    state: State,
    new_pages: DataFrame,
    landed_pages: DataFrame,
    as_of: Column,
    provider: Provider | None = None,
    provider_name: str = "openrouter",
    model: str = "",
    prompt_version: str = "v1",
) -> tuple[State, DataFrame]:
    """Fetch, extract and analyze new pages (page_id, scan_run_id): (state, counters per scan). Without any nothing is read."""
    if new_pages.isEmpty():
        return state, new_pages.filter(F.lit(False)).select("scan_run_id", *[F.lit(0).cast("bigint").alias(c) for c in PIPELINE_COUNTS])
    targets = fetch_targets(new_pages, state["pages"], state["competitors"]).join(new_pages, "page_id")
    fetched = resolve_redirects(targets.drop("competitor_id"), landed_pages, keys=["page_id", "scan_run_id"])
    results = write_down(fetch_results(fetched))
    state = save_fetches(state, results, as_of)

    fresh = results.filter(F.col("fetch_status") == "success").select("page_id", "scan_run_id")
    pages = state["pages"].join(fresh, state["pages"]["id"] == fresh["page_id"], "left_semi")
    inputs = analysis_input(pages, state["page_seo_data"])
    responses = analyze(inputs, provider) if provider else None
    asked = fresh.join(inputs.select("page_id"), "page_id", "left_semi")
    outcomes = cut_lineage(analysis_outcomes(asked, responses, as_of, provider_name, model, prompt_version))
    analyses, events = append_analyses(state["page_analyses"], state["page_events"], outcomes, as_of)
    state = state | {"page_analyses": analyses, "page_events": events}
    return state, pipeline_counters(results, outcomes)


def run_scans(
    state: State,
    landed: Landed,
    as_of: datetime | str | Column,
    ids: DataFrame | None = None,
    trigger: str = "cron",
    provider: Provider | None = None,
    limits: Limits = Limits(),
    **provider_args: str,
) -> ScanResult:
    """Scan all enabled competitors (or those in ``ids``): one bad competitor is a row, never a failed job.

    landed: responses for ``sitemaps``, ``roots`` (robots.txt and common paths) and ``pages``.
    """
    as_of = moment(as_of)
    candidates = not_deleted(state["competitors"])
    wanted = candidates.filter("is_enabled")
    rejects = []
    if ids is not None:
        asked = ids.select(F.col("competitor_id").alias("id")).distinct()
        rejects.append(asked.join(wanted.select("id"), "id", "left_anti").select(
            F.col("id").alias("competitor_id"), F.lit(NOT_ENABLED).alias("code")))
        wanted = wanted.join(asked, "id", "left_semi")

    roots = discover_roots(wanted, state["sitemap_sources"], landed["roots"])
    sources = cut_lineage(add_root_sources(state["sitemap_sources"], roots, as_of))
    with_source = enabled(sources).select(F.col("competitor_id").alias("id"))
    rejects.append(wanted.join(with_source, "id", "left_anti").select(
        F.col("id").alias("competitor_id"), F.lit(NO_SITEMAP).alias("code")))
    ready = wanted.join(with_source, "id", "left_semi")

    requests = ready.select(F.col("id").alias("competitor_id"), F.lit(trigger).alias("trigger_type"))
    scan_runs, opened, busy = open_scans(state["scan_runs"], requests, as_of)
    rejects.append(busy.select("competitor_id", "code"))
    scans = cut_lineage(
        opened.select(F.col("id").alias("scan_run_id"), "competitor_id").join(
            ready.select(F.col("id").alias("competitor_id"), "domain", "baseline_established"), "competitor_id"))

    seeds = seed_order(join_dimension(sources, scans.select("competitor_id", "domain"), ["competitor_id"], ["id"])).select(
        "competitor_id", "domain", F.col("id").alias("source_id"), "url", "seed_order")
    sitemap_requests = join_dimension(
        landed["sitemaps"].select("competitor_id", "url").distinct(), scans.select("competitor_id", "domain"), ["competitor_id"], ["url"])
    docs = resolve_redirects(sitemap_requests, landed["sitemaps"], by_competitor=True).withColumnRenamed("error_code", "error_source")
    expansion = expand_sitemaps(seeds, docs, limits)
    visits, entries = cut_lineage(expansion.visits), expansion.entries
    sources = cut_lineage(add_child_sources(sources, expansion.children, as_of))

    scans = scans.join(scan_complete(visits, ["competitor_id"]), "competitor_id")
    first = scans.filter(~F.col("baseline_established") & F.col("is_complete"))
    later = scans.filter("baseline_established")
    state = state | {
        "sitemap_sources": sources,
        "scan_runs": scan_runs,
        "scan_sitemaps": state["scan_sitemaps"].unionByName(record_processed(visits, sources, scans, as_of)),
    }
    state = establish_baseline(state, entries, first, as_of)

    known = later.select("competitor_id")
    classified = cut_lineage(
        D.classify_scan(entries.join(known, "competitor_id", "left_semi"), state["pages"], later))
    state = apply_diff(state, classified, as_of)
    state = state | {"pages": cut_lineage(state["pages"])}
    new_pages = classified.filter(F.col("change_type") == D.NEW).select(
        page_id().alias("page_id"), F.col("scan.scan_run_id").alias("scan_run_id"))
    state, counters = process_new_pages(state, new_pages, landed["pages"], as_of, provider, **provider_args)

    changes = D.scan_counters(classified.filter(F.col("scan").isNotNull()), visits, entries)
    errors = error_summary(visits, ["competitor_id"])
    results = scans.join(changes, "competitor_id").join(errors, "competitor_id", "left")
    status = scan_status(F.col("baseline_established"), F.col("is_complete"))
    results = cut_lineage(results.withColumns(
        {
            "status": status,
            "error_summary": F.when(~F.col("baseline_established") & F.col("is_complete"), F.lit(None).cast("string"))
            .when(~F.col("baseline_established"), F.coalesce("error_summary", F.lit(BASELINE_INCOMPLETE)))
            .otherwise(F.col("error_summary")),
        }
    ))
    runs, competitors = close_scans(state["scan_runs"], state["competitors"], results, as_of)
    state = state | {"scan_runs": write_pipeline_counts(runs, counters), "competitors": competitors}
    summaries = results.select(
        "scan_run_id", "competitor_id", "status", "is_complete", "sitemap_count", "total_url_count", "new_count",
        "missing_count", "reappeared_count", "error_summary")
    refused = rejects[0]
    for more in rejects[1:]:
        refused = refused.unionByName(more)
    return ScanResult(state, summaries, refused)
