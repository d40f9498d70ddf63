"""Sitemap-index expansion: depth-first order computed with joins.

A walk visits documents depth first from the ordered seeds, one visited set per competitor. Every encounter
of a document has a *path*: the seed ordinal followed by child ordinals, written as fixed-width hex, so
text order is walk order. As long as no document at the deepest level has children, the walk first meets
a document at its smallest path, and that path extends the smallest path of its parent. So it is enough
to keep one best path per document and relax level by level; cycles never improve a path.

A document met at the deepest level is visited but not expanded. That changes what the walk reaches
later, so such documents (when their whole path is settled) lose their children and the relaxation runs
again, until no new one turns up. The first of them in walk order is always settled, hence it ends.

Limits follow from the paths: everything past the last allowed visit is over the count limit, children
of the deepest level are over the depth limit. No competitor is ever gathered into one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.text import content_hash
from sitetide.functions.urls import inspect_url, normalize_url
from sitetide.operators.joins import join_dimension
from sitetide.operators.redirects import LIMIT_CODE
from sitetide.operators.windows import first_entry, first_wins, top_rows
from sitetide.session import cut_lineage
from sitetide.sources.sitemaps import exploded_nodes, parse_documents
from sitetide.sources.tables import size_error, too_large

STEP = 8
#: Levels of a walk that one job computes.
LEVELS = 3
ALREADY_PROCESSED = "Already processed in this scan"
NOT_LANDED = "No landed response"


@dataclass(frozen=True)
class Limits:
    """Bounds of a walk, each only if it is given."""

    max_depth: int | None = None
    max_sitemaps: int | None = None
    max_urls: int | None = None
    max_bytes: int | None = None


# The bounds that a live crawler uses by default.
CRAWLER_LIMITS = Limits(max_depth=5, max_sitemaps=100, max_urls=10_000, max_bytes=5_000_000)


class Expansion(NamedTuple):
    visits: DataFrame
    entries: DataFrame
    children: DataFrame


def ordinal(col: Column) -> Column:
    return F.lpad(F.hex(col.cast("bigint")), STEP, "0")


def depth_of(path: Column) -> Column:
    return (F.length(path) / STEP).cast("int") - 1


def sitemap_outcome(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Fetch-and-parse outcome of every landed document: ``error_code``, ``error_message``, ``http_status``.

    Expects the columns of ``parse_documents`` plus status, content_length, body, error, error_source.
    Size is checked before the HTTP status because the body is read first.
    """
    large = too_large("body", "content_length", max_bytes)
    http_error = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    code = (
        F.when(F.col("error_source") == LIMIT_CODE, F.lit("SITEMAP_REDIRECT_LIMIT"))
        .when(F.col("error").isNotNull(), F.lit("SITEMAP_FETCH_FAILED"))
        .when(large, F.lit("SITEMAP_RESPONSE_TOO_LARGE"))
        .when(http_error, F.lit("SITEMAP_HTTP_ERROR"))
        .when(F.col("parse_error").isNotNull(), F.lit("SITEMAP_FETCH_FAILED"))
    )
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(large, F.lit(size_error(max_bytes)))
        .when(http_error, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
    )
    keeps_status = code.isNull() | code.isin(
        "SITEMAP_REDIRECT_LIMIT", "SITEMAP_RESPONSE_TOO_LARGE", "SITEMAP_HTTP_ERROR")
    return docs.withColumns(
        {
            "error_code": code,
            "error_message": message,
            "http_status": F.when(keeps_status, F.col("status")),
            "content_hash": F.when(code.isNull(), content_hash(F.coalesce("body", F.lit("")))),
        }
    )


def prepare_documents(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Landed documents (competitor_id, domain, url, status, content_length, body, error, error_source) to slim rows.

    One row per (competitor_id, document): outcome plus node list, without the body. A landed response
    answers for every spelling that normalizes to the same URL.
    """
    parsed = sitemap_outcome(parse_documents(docs), max_bytes)
    ok = F.col("error_code").isNull()
    none = F.array().cast("array<struct<loc:string,lastmod:string>>")
    slim = parsed.select(
        "competitor_id",
        "domain",
        normalize_url("url").alias("document"),
        F.col("url").alias("landed_url"),
        "http_status",
        "content_hash",
        "error_code",
        "error_message",
        F.when(ok, F.col("doc_type")).alias("doc_type"),
        F.when(ok, F.col("nodes")).otherwise(none).alias("nodes"),
    ).filter(F.col("document").isNotNull())
    return first_wins(slim, ["competitor_id", "document"], [
        F.col("landed_url").asc(), F.col("http_status").asc(), F.col("content_hash").asc(), F.col("error_code").asc()])


def index_edges(documents: DataFrame) -> DataFrame:
    """(competitor_id, parent, ordinal, url, child, reason) of every child declaration."""
    raw = exploded_nodes(documents, "sitemapindex", ["competitor_id", "domain", "document"])
    return raw.withColumn("_seen", inspect_url("loc", "domain")).select(
        "competitor_id",
        F.col("document").alias("parent"),
        F.col("position").alias("ordinal"),
        F.col("loc").alias("url"),
        F.when(F.col("_seen.reason").isNull(), F.col("_seen.normalized_url")).alias("child"),
        F.col("_seen.reason").alias("reason"),
    )


def _extended(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """One level further: the smallest path to each child, never back to a document of the path itself."""
    reached = frontier.join(steps, ["competitor_id", "document"]).filter(~F.array_contains("above", F.col("child")))
    return reached.groupBy("competitor_id", F.col("child").alias("document")).agg(
        F.min(F.struct(F.concat("path", "_step").alias("path"), F.array_append("above", F.col("child")).alias("above"))).alias("p")
    ).select("competitor_id", "document", "p.path", "p.above")


def index_paths(starts: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """Smallest path per (competitor_id, document) of the documents that have children, over all chains (of at most
    ``max_depth`` steps).

    Only these documents can lead further, so the relaxation runs on the edges between them, few beside all that are listed.
    Each turn takes the paths found last LEVELS levels further in one job; what it improves is added to a log, and the improved
    paths of the last level are the next frontier. Paths through a document twice never improve anything, so it ends
    without a bound as well.
    """
    parents = edges.select("competitor_id", F.col("parent").alias("document")).distinct()
    steps = cut_lineage(edges.select(
        "competitor_id", F.col("parent").alias("document"), "child", ordinal(F.col("ordinal")).alias("_step")).join(
        parents.withColumnRenamed("document", "child"), ["competitor_id", "child"], "left_semi"))
    smallest = F.min("path").alias("path")
    first = starts.select("competitor_id", "document", "path").join(parents, ["competitor_id", "document"], "left_semi").groupBy(
        "competitor_id", "document").agg(smallest)
    log = cut_lineage(first)  # every path that was the smallest for a time; the smallest of a document counts
    frontier, level = log.withColumn("above", F.array("document")), 0
    while max_depth is None or level < max_depth:
        levels = LEVELS if max_depth is None else min(LEVELS, max_depth - level)
        reached = None
        for _ in range(levels):
            frontier = _extended(frontier, steps)
            reached = frontier if reached is None else reached.unionByName(frontier)
        level += levels
        known = log.groupBy("competitor_id", "document").agg(F.min("path").alias("_known"))
        found = reached.groupBy("competitor_id", "document").agg(F.min(F.struct("path", "above")).alias("p")).select(
            "competitor_id", "document", "p.path", "p.above")
        improved = cut_lineage(found.join(known, ["competitor_id", "document"], "left").filter(
            F.col("_known").isNull() | (F.col("path") < F.col("_known"))).drop("_known"))
        log = log.unionByName(improved.drop("above"))
        frontier = improved.filter(F.length("path") == (level + 1) * STEP)
        if frontier.isEmpty():
            break
    return log.groupBy("competitor_id", "document").agg(smallest)


def _met(starts: DataFrame, edges: DataFrame, best: DataFrame, max_depth: int | None) -> DataFrame:
    """Every encounter of the walk that starts or is listed by a document with children; deeper ones than the walk goes too."""
    listing = best.select("competitor_id", F.col("document").alias("parent"), F.col("path").alias("_parent_path"))
    if max_depth is not None:
        listing = listing.filter(F.length("_parent_path") <= (max_depth + 1) * STEP)
    below = join_dimension(edges, listing, ["competitor_id", "parent"], ["ordinal"]).select(
        "competitor_id",
        F.lit(None).cast("string").alias("source_id"),
        "url",
        F.concat("_parent_path", ordinal(F.col("ordinal"))).alias("path"),
        F.col("child").alias("document"),
        "reason",
        "_parent_path",
    )
    return starts.withColumn("_parent_path", F.lit(None).cast("string")).unionByName(below)


def _first_met(met: DataFrame, max_depth: int | None) -> DataFrame:
    """(competitor_id, document, path): where the walk first meets each document, as deep as it goes."""
    within = met.filter(F.col("document").isNotNull())
    if max_depth is not None:
        within = within.filter(F.length("path") <= (max_depth + 1) * STEP)
    return within.groupBy("competitor_id", "document").agg(F.min("path").alias("path"))


def _dead_ends(starts: DataFrame, edges: DataFrame, best: DataFrame, limits: Limits) -> DataFrame:
    """Settled documents at the deepest level that have children and could still be visited."""
    hits = best.filter(F.length("path") == (limits.max_depth + 1) * STEP)
    if limits.max_sitemaps is not None:
        window = Window.partitionBy("competitor_id").orderBy("path")
        met = _met(starts, edges, best.filter(F.length("path") <= limits.max_depth * STEP), limits.max_depth)
        reachable = _first_met(met, limits.max_depth).withColumn("_rank", F.row_number().over(window)).filter(
            F.col("_rank") <= limits.max_sitemaps)
        hits = hits.join(reachable.select("competitor_id", "path"), ["competitor_id", "path"], "left_semi")
    prefixes = hits.select(
        "competitor_id",
        "document",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.lit(limits.max_depth)), lambda i: F.substring(F.col("path"), F.lit(1), i * STEP)
        )).alias("path"),
    ) if limits.max_depth else hits.select("competitor_id", "document", "path")
    settled = (
        prefixes.join(best.select("competitor_id", "path"), ["competitor_id", "path"], "left_semi")
        .groupBy("competitor_id", "document")
        .count()
        .filter(F.col("count") == max(limits.max_depth, 1))
    )
    return settled.select("competitor_id", "document")


def encounters_of(starts: DataFrame, edges: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(encounters, first visits in order) of a limited walk; an encounter listed by a document that isn't visited is none."""
    open_edges = edges
    best = index_paths(starts, edges, limits.max_depth)
    while limits.max_depth is not None:
        deepest = best.filter(F.length("path") == (limits.max_depth + 1) * STEP)
        if deepest.isEmpty():
            break
        dead_ends = cut_lineage(_dead_ends(starts, open_edges, best, limits))
        if dead_ends.isEmpty():
            break
        open_edges = cut_lineage(open_edges.join(
            dead_ends.withColumnRenamed("document", "parent"), ["competitor_id", "parent"], "left_anti"))
        best = index_paths(starts, open_edges, limits.max_depth)
    if limits.max_depth is None:
        met = cut_lineage(_met(starts, edges, best, None))
        return met, _visits(_first_met(met, None), limits)
    # the children of a document at the deepest level are met, but too deep: their listing documents are the first met ones
    shallow = best.filter(F.length("path") <= limits.max_depth * STEP)
    visited = cut_lineage(_visits(_first_met(_met(starts, open_edges, shallow, limits.max_depth), limits.max_depth), limits))
    return cut_lineage(_met(starts, edges, visited, limits.max_depth)), visited


def _visits(best: DataFrame, limits: Limits) -> DataFrame:
    """The documents in the order of the walk; numbered only where their number is bounded."""
    if limits.max_sitemaps is None:
        return best.withColumn("visit", F.lit(None).cast("int"))
    window = Window.partitionBy("competitor_id").orderBy("path")
    return best.withColumn("visit", F.row_number().over(window)).filter(F.col("visit") <= limits.max_sitemaps)


def _capped_entries(found: DataFrame, visits: DataFrame, max_urls: int | None) -> tuple[DataFrame, DataFrame]:
    """Apply the URL cap: (entries kept, per-document counts and whether the cap stopped it).

    Whole documents are decided from their counts; positions are only ranked inside the one document
    per competitor in which the cap falls. The distinct entries are written once and read by each step.
    """
    doc = ["competitor_id", "path"]
    entries = cut_lineage(first_entry(found))
    added = entries.groupBy(*doc).agg(F.count(F.lit(1)).alias("added"))
    if max_urls is None:
        return entries, added.withColumn("over_cap", F.lit(False))
    before = Window.partitionBy("competitor_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        visits.select(*doc, "node_count")
        .join(added, doc, "left")
        .withColumn("added", F.coalesce("added", F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("added").over(before), F.lit(0)))
        .withColumn("room", F.greatest(F.lit(max_urls) - F.col("before"), F.lit(0)))
    )
    straddling = counts.filter((F.col("room") > 0) & (F.col("added") >= F.col("room"))).select(*doc, "room")
    full_at = (
        entries.select(*doc, "position")
        .join(straddling, doc)
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*doc).orderBy("position")))
        .filter(F.col("_rn") == F.col("room"))
        .select(*doc, F.col("position").alias("full_at"))
    )
    over = F.when(F.col("room") == 0, F.col("node_count") > 0).otherwise(
        F.coalesce(F.col("node_count") - 1 > F.col("full_at"), F.lit(False)))
    counts = cut_lineage(
        counts.join(full_at, doc, "left").select(
            *doc, F.least("added", "room").alias("added"), "room", "full_at", over.alias("over_cap")))
    kept = entries.join(counts.select(*doc, "room", "full_at"), doc).filter(
        (F.col("room") > 0) & (F.col("full_at").isNull() | (F.col("position") <= F.col("full_at"))))
    return kept.drop("room", "full_at"), counts.drop("room", "full_at")


def expand_sitemaps(seeds: DataFrame, docs: DataFrame, limits: Limits = Limits()) -> Expansion:
    """Walk the sitemap index of every competitor.

    seeds: competitor_id, domain, source_id, url, seed_order (0-based, contiguous not required).
    docs: landed responses, see ``prepare_documents``.
    """
    documents = cut_lineage(prepare_documents(docs, limits.max_bytes))
    edges = cut_lineage(index_edges(documents))
    starts = seeds.withColumn("_seen", inspect_url("url", "domain")).select(
        "competitor_id",
        "source_id",
        "url",
        ordinal(F.col("seed_order")).alias("path"),
        F.when(F.col("_seen.reason").isNull(), F.col("_seen.normalized_url")).alias("document"),
        F.col("_seen.reason").alias("reason"),
    )
    met, visited = encounters_of(starts, edges, limits)
    if limits.max_depth is None and limits.max_sitemaps is not None:
        # what a document past the last visit lists is never met
        visited = cut_lineage(visited)
        met = met.join(visited.select("competitor_id", F.col("path").alias("_parent_path")), ["competitor_id", "_parent_path"], "left_semi").select(
            *met.columns).unionByName(met.filter(F.col("_parent_path").isNull()))
    encounters = met.join(
        visited.select("competitor_id", "path", F.lit(True).alias("_first")), ["competitor_id", "path"], "left")
    too_many = F.lit(False)
    if limits.max_sitemaps is not None:
        last = visited.filter(F.col("visit") == limits.max_sitemaps).select(
            "competitor_id", F.col("path").alias("_last_path"))
        encounters = join_dimension(encounters, last, ["competitor_id"], ["path"], "left")
        too_many = F.coalesce(F.col("path") > F.col("_last_path"), F.lit(False))
    too_deep = F.lit(False) if limits.max_depth is None else depth_of(F.col("path")) > limits.max_depth
    encounters = encounters.withColumn(
        "_kind",
        F.when(too_deep, F.lit("depth"))
        .when(too_many, F.lit("count"))
        .when(F.col("reason").isNotNull(), F.lit("rejected"))
        .when(F.col("_first"), F.lit("visit"))
        .otherwise(F.lit("repeat")),
    ).drop("_first", "_last_path")
    encounters = cut_lineage(encounters)

    visits = encounters.filter(F.col("_kind") == "visit").select("competitor_id", "path", "document", "url")
    visited_docs = visits.join(
        documents.withColumn("node_count", F.when(F.col("doc_type") == "urlset", F.size("nodes")).otherwise(F.lit(0))),
        ["competitor_id", "document"],
        "left",
    )
    found = (
        exploded_nodes(
            visited_docs.withColumn("source_url", F.col("url")),
            "urlset",
            ["competitor_id", "domain", "path", "source_url"],
        )
        .withColumn("_seen", inspect_url("loc", "domain"))
        .filter(F.col("_seen.reason").isNull() & F.col("_seen.normalized_url").isNotNull())
        .select(
            "competitor_id", "path", "position", F.col("loc").alias("url"),
            F.col("_seen.normalized_url").alias("normalized_url"), "lastmod", "source_url")
    )
    entries, counts = _capped_entries(
        found, visited_docs.select("competitor_id", "path", F.coalesce("node_count", F.lit(0)).alias("node_count")),
        limits.max_urls)

    fetched = visited_docs.select(
        "competitor_id", "path", "http_status", "content_hash",
        F.when(F.col("landed_url").isNull(), F.lit("SITEMAP_FETCH_FAILED")).otherwise(F.col("error_code")).alias("_code"),
        F.when(F.col("landed_url").isNull(), F.lit(NOT_LANDED)).otherwise(F.col("error_message")).alias("_message"),
    ).join(counts, ["competitor_id", "path"], "left")
    parents = visits.select("competitor_id", F.col("path").alias("_parent_path"), F.col("url").alias("parent_url"))
    processed = (
        encounters.join(fetched, ["competitor_id", "path"], "left")
        .join(parents, ["competitor_id", "_parent_path"], "left")
    )
    over_cap = F.coalesce("over_cap", F.lit(False)) & F.col("_code").isNull()
    kind = F.col("_kind")
    code = (
        F.when(kind == "depth", F.lit("SITEMAP_DEPTH_LIMIT"))
        .when(kind == "count", F.lit("SITEMAP_COUNT_LIMIT"))
        .when(kind == "rejected", F.lit("SITEMAP_URL_REJECTED"))
        .when(over_cap, F.lit("SITEMAP_URL_LIMIT"))
        .otherwise(F.col("_code"))
    )
    message = (
        F.when(kind == "depth", F.lit(f"Maximum Sitemap depth {limits.max_depth} exceeded"))
        .when(kind == "count", F.lit(f"Maximum Sitemap count {limits.max_sitemaps} exceeded"))
        .when(kind == "rejected", F.col("reason"))
        .when(kind == "repeat", F.lit(ALREADY_PROCESSED))
        .when(over_cap, F.lit(f"Maximum URL count {limits.max_urls} exceeded"))
        .otherwise(F.col("_message"))
    )
    visits_out = processed.select(
        "competitor_id",
        "path",
        "source_id",
        "url",
        "document",
        "parent_url",
        depth_of(F.col("path")).alias("depth"),
        F.when(kind == "repeat", F.lit("skipped")).when(code.isNotNull(), F.lit("failed"))
        .otherwise(F.lit("success")).alias("status"),
        "http_status",
        F.when(code.isNull(), F.col("content_hash")).alias("content_hash"),
        F.when(code.isNull(), F.coalesce("added", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("url_count"),
        code.alias("error_code"),
        message.alias("error_message"),
    )
    children = discovered_children(encounters, parents)
    return Expansion(visits_out, entries, children)


def discovered_children(encounters: DataFrame, parents: DataFrame) -> DataFrame:
    """Allowed child declarations of visited index documents, duplicates kept."""
    return (
        encounters.filter(F.col("_parent_path").isNotNull() & F.col("reason").isNull())
        .join(parents, ["competitor_id", "_parent_path"])
        .select("competitor_id", "path", "url", F.col("document").alias("normalized_url"), "parent_url")
    )


def sitemap_url_counts(entries: DataFrame, visits: DataFrame) -> DataFrame:
    """URLs each document contributed first; documents without any stay with 0."""
    counted = entries.groupBy("competitor_id", "path").agg(F.count(F.lit(1)).alias("url_count"))
    return visits.select("competitor_id", "path", "url").join(counted, ["competitor_id", "path"], "left").withColumn(
        "url_count", F.coalesce("url_count", F.lit(0)))


def scan_complete(processed: DataFrame, keys: list[str]) -> DataFrame:
    """A scan is complete when no processed sitemap failed; skipped ones do not matter."""
    return processed.groupBy(*keys).agg(F.bool_and(F.col("status") != "failed").alias("is_complete"))


def first_lines(processed: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The failed documents; with ``n`` the first ones of each key in the order of the walk."""
    failed = processed.filter(F.col("status") == "failed")
    return failed if n is None else top_rows(failed, keys, [F.col("path").asc()], n)
