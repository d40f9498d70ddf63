"""Whole scans over sites, sitemaps and landed pages derived from the driver pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.operators.analysis import rule_provider
from sitetide.operators.windows import first_wins
from sitetide.plans.reports import dashboard, list_pages
from sitetide.plans.scan import discover_roots, run_scans
from sitetide.queries import inputs as I
from sitetide.queries import page_queries as PQ
from sitetide.queries import sitemap_queries as SQ
from sitetide.queries import state_queries as ST
from sitetide.queries.registry import query
from sitetide.schemas import TABLES, conform, empty_table
from sitetide.session import cut_lineage


def _kind():
    """A number from 0 to 15 for each site. Four kinds have no enabled source: 1 and 9 declare one in robots.txt (that of 9 is stored
    already, switched off), 5 answers at a common path, 13 does neither."""
    return F.conv(F.substring(F.md5("domain"), 1, 1), 16, 10).cast("int")


def _no_source():
    return _kind() % 4 == 1


def site_state(spark, sf):
    """One competitor per host, most with their sitemap.xml as source, and four of five pages already known."""
    t = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    sites = SQ.seeds(spark, sf)
    competitors = conform(sites.select(
        F.col("competitor_id").alias("id"), F.col("competitor_id").alias("name"), "domain", F.lit(True).alias("is_enabled"),
        (F.length("domain") % 3 != 0).alias("baseline_established"), t.alias("created_at"), t.alias("updated_at")), "competitors")
    sources = conform(sites.filter(~_no_source() | (_kind() == 9)).select(
        F.col("source_id").alias("id"), "competitor_id", "url", F.col("url").alias("normalized_url"), F.lit("manual").alias("source_type"),
        (~_no_source()).alias("is_enabled"), F.lit(False).alias("is_discovered"), t.alias("created_at"), t.alias("updated_at")), "sitemap_sources")
    pages = I.state_pages(spark, sf).filter("deleted_at IS NULL").filter(F.length("competitor_id") % 3 != 0)
    pages = first_wins(pages, ["competitor_id", "normalized_url"], [F.col("id").cast("bigint").asc()])
    return {name: empty_table(spark, name) for name in TABLES} | {
        "competitors": competitors, "sitemap_sources": sources, "pages": pages}


def landed(spark, sf):
    none = F.lit(None).cast("string")
    rest = [none.alias("location"), none.alias("content_type")]
    sitemaps = SQ.sitemap_docs(spark, sf).select(
        "competitor_id", "url", "status", *rest, "content_length", "body", "error")
    base = F.concat(F.lit("https://"), "domain")
    declares, answers = _kind().isin(1, 9), _kind() == 5
    files = F.array(
        F.struct(F.concat(base, F.lit("/robots.txt")).alias("url"), F.when(declares, 200).otherwise(404).alias("status"),
                 F.concat(F.lit("User-agent: *\nSitemap: "), base, F.lit("/sitemap.xml\n")).alias("body")),
        F.struct(F.concat(base, F.lit("/sitemap.xml")).alias("url"), F.when(answers, 200).otherwise(410).alias("status"),
                 F.rpad(F.lit("<sitemapindex>"), 5000, " ").alias("body")))
    roots = SQ.seeds(spark, sf).filter(_no_source()).select("competitor_id", F.inline(files)).select(
        "competitor_id", "url", "status", *rest, none.alias("content_length"), "body", none.alias("error"))
    pid = F.col("page_id")
    pages = I.read(spark, sf, "pages").select(
        I.host().alias("competitor_id"), F.col("url"), F.when(pid % 10 == 5, F.lit(404)).otherwise(F.lit(200)).alias("status"), none.alias("location"),
        F.lit("text/html").alias("content_type"), none.alias("content_length"), F.col("html").alias("body"), none.alias("error"))
    return {"sitemaps": sitemaps, "pages": pages, "roots": roots}


def scanned(spark, sf):
    """Tables that are derived here and read many times in a scan are written down first, as stored and landed ones are."""
    state, arrived = site_state(spark, sf), landed(spark, sf)
    state |= {name: cut_lineage(state[name]) for name in ("competitors", "sitemap_sources", "pages")}
    arrived |= {name: cut_lineage(arrived[name]) for name in ("sitemaps", "roots")}
    return run_scans(state, arrived, I.AS_OF, provider=rule_provider, model="rules")


KIND_SQL = "(strpos('0123456789abcdef', substr(md5(host), 1, 1)) - 1)"

# Sites of kinds 9 and 13 have no enabled source, and none is found: they are not scanned.
SCAN_SQL = f"""{SQ.VISITS_SQL}, done AS (SELECT host, bool_and(error_code IS NULL) AS is_complete, length(host) % 3 <> 0 AS based, count(*) AS sitemap_count
  FROM v WHERE {KIND_SQL} NOT IN (9, 13) GROUP BY 1),
existing AS (SELECT host, normalized_url, arg_min(lifecycle_status, page_id) AS status, arg_min(streak, page_id) AS streak FROM (
  SELECT {I.HOST_SQL} AS host, {I.norm_sql('url')} AS normalized_url, page_id,
    CASE page_id % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'active' WHEN 2 THEN 'new' ELSE 'missing' END AS lifecycle_status,
    CASE WHEN page_id % 4 = 3 THEN 2 ELSE page_id % 2 END AS streak
  FROM pages WHERE page_id % 5 <> 0 AND page_id % 11 <> 0 AND length({I.HOST_SQL}) % 3 <> 0) GROUP BY 1, 2),
class AS (SELECT d.host, d.is_complete, d.based, f.url, coalesce(f.normalized_url, e.normalized_url) AS normalized_url,
    CASE WHEN NOT d.based THEN NULL WHEN e.host IS NULL AND d.is_complete THEN 'new' WHEN f.host IS NOT NULL AND e.status = 'missing' THEN 'reappeared'
      WHEN f.host IS NULL AND d.is_complete AND e.status <> 'missing' AND e.streak >= 1 THEN 'gone' END AS change
  FROM (SELECT * FROM first) f FULL OUTER JOIN existing e ON e.host = f.host AND e.normalized_url = f.normalized_url
  JOIN done d ON d.host = coalesce(f.host, e.host))"""


@query("run_scans", f"""{SCAN_SQL}
SELECT d.host AS competitor_id, CASE WHEN d.is_complete THEN 'success' WHEN d.based THEN 'partial_success' ELSE 'failed' END AS status, d.is_complete, d.sitemap_count,
  count(c.url) AS total_url_count, count(*) FILTER (change = 'new') AS new_count, count(*) FILTER (change = 'gone') AS missing_count, count(*) FILTER (change = 'reappeared') AS reappeared_count
FROM done d LEFT JOIN class c ON c.host = d.host GROUP BY ALL""")
def run_all_scans(spark, sf):
    return scanned(spark, sf).summaries.drop("scan_run_id", "error_summary")


@query("run_scan_counters", f"""{SCAN_SQL}, fresh AS (
  SELECT c.host, p.page_id % 10 = 5 AS bad FROM class c JOIN pages p ON p.url = c.url WHERE change = 'new')
SELECT d.host AS competitor_id, coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) FILTER (bad IS NOT NULL), 0)::BIGINT AS fetch_success_count,
  coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END), 0)::BIGINT AS fetch_failed_count,
  coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) FILTER (bad IS NOT NULL), 0)::BIGINT AS analysis_success_count, 0::BIGINT AS analysis_failed_count
FROM done d LEFT JOIN fresh f ON f.host = d.host GROUP BY 1""")
def run_scan_counters(spark, sf):
    runs = scanned(spark, sf).state["scan_runs"]
    return runs.select(
        "competitor_id", "fetch_success_count", "fetch_failed_count", "analysis_success_count", "analysis_failed_count")


@query("run_scan_pages", f"""{SCAN_SQL}
SELECT lifecycle_status, count(*) AS pages FROM (
  SELECT CASE WHEN NOT based THEN 'baseline' WHEN change = 'new' THEN 'new' WHEN change = 'reappeared' THEN 'reappeared' WHEN change = 'gone' THEN 'missing'
    WHEN c.url IS NOT NULL AND e.host IS NOT NULL THEN 'active' ELSE e.status END AS lifecycle_status
  FROM class c LEFT JOIN existing e ON e.host = c.host AND e.normalized_url = c.normalized_url
  WHERE e.host IS NOT NULL OR change = 'new' OR (NOT based AND is_complete)
  UNION ALL SELECT status FROM existing WHERE host NOT IN (SELECT host FROM done)) GROUP BY 1""")
def run_scan_pages(spark, sf):
    return scanned(spark, sf).state["pages"].groupBy("lifecycle_status").agg(F.count(F.lit(1)).alias("pages"))


@query("run_scan_rejects", f"""WITH {SQ.PARTS_SQL}
SELECT host AS competitor_id, 'NO_SITEMAP' AS code FROM hosts WHERE {KIND_SQL} IN (9, 13)""")
def run_scan_rejects(spark, sf):
    return scanned(spark, sf).rejects


@query("run_scan_sources", f"""WITH {SQ.PARTS_SQL}, root AS (
  SELECT host, 'https://' || host || '/sitemap.xml' AS url,
    CASE WHEN {KIND_SQL} % 4 <> 1 OR {KIND_SQL} = 9 THEN 'manual' WHEN {KIND_SQL} = 1 THEN 'robots' WHEN {KIND_SQL} = 5 THEN 'common_path' END AS kind FROM hosts)
SELECT host AS competitor_id, url AS normalized_url, kind AS source_type, {KIND_SQL} <> 9 AS is_enabled FROM root WHERE kind IS NOT NULL
UNION ALL SELECT host, url, 'sitemap_index_child', TRUE FROM docs WHERE parent IS NOT NULL AND {KIND_SQL} NOT IN (9, 13)""")
def run_scan_sources(spark, sf):
    """Stored sources after a scan: found roots and listed children come in; a switched-off source stays as it is."""
    sources = scanned(spark, sf).state["sitemap_sources"]
    return sources.select("competitor_id", "normalized_url", "source_type", "is_enabled")


@query("discover_roots", f"""WITH {SQ.ROBOTS_SQL}
SELECT host AS competitor_id, 'https://' || host || '/map-' || n || '.xml' AS normalized_url, 'robots' AS source_type FROM robots WHERE n % 3 <> 0 AND n % 2 = 0
UNION ALL SELECT host, 'https://' || host || '/sitemap.xml', 'common_path' FROM robots WHERE n % 3 <> 0""")
def discovered_roots(spark, sf):
    """Hosts without an enabled source: robots.txt behind a redirect for every other one, sitemap.xml for all."""
    hosts = I.read(spark, sf, "pages").groupBy(I.host().alias("host")).agg(F.min("page_id").alias("n"))
    base = F.concat(F.lit("https://"), "host")
    none = F.lit(None).cast("string")
    t = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    files = F.array(
        F.struct(F.concat(base, F.lit("/robots.txt")).alias("url"), F.lit(302).alias("status"), F.lit("/r.txt").alias("location"), none.alias("body")),
        F.struct(F.concat(base, F.lit("/r.txt")).alias("url"), F.when(F.col("n") % 2 == 0, 200).otherwise(404).alias("status"), none.alias("location"),
                 F.concat(F.lit("Sitemap: "), base, F.lit("/map-"), F.col("n").cast("string"), F.lit(".xml")).alias("body")),
        F.struct(F.concat(base, F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), none.alias("location"), F.lit("<urlset>").alias("body")),
    )
    roots = hosts.select(F.col("host").alias("competitor_id"), F.inline(files)).select(
        "competitor_id", "url", "status", "location", none.alias("content_type"), none.alias("content_length"), "body", none.alias("error"))
    competitors = hosts.select(F.col("host").alias("id"), F.col("host").alias("domain"))
    sources = conform(hosts.filter(F.col("n") % 3 == 0).select(
        F.col("host").alias("id"), F.col("host").alias("competitor_id"), base.alias("url"), base.alias("normalized_url"), F.lit("manual").alias("source_type"),
        F.lit(True).alias("is_enabled"), F.lit(False).alias("is_discovered"), t.alias("created_at"), t.alias("updated_at")), "sitemap_sources")
    return discover_roots(competitors, sources, roots).select("competitor_id", "normalized_url", "source_type")


@query("dashboard", f"""WITH {I.COMPETITORS_SQL}, {I.state_pages_sql(None)}, {I.PAGE_REVIEW_SQL}, active AS (
  SELECT p.* FROM state_pages p JOIN competitors c ON c.id = p.competitor_id WHERE NOT p.is_deleted AND NOT c.is_deleted)
SELECT 'competitors' AS number, count(*) AS value FROM competitors WHERE NOT is_deleted
UNION ALL SELECT 'today_new', count(*) FROM active WHERE first_seen_at >= date_trunc('day', {I.AS_OF_SQL}) AND lifecycle_status = 'new'
UNION ALL SELECT 'seven_day_new', count(*) FROM active WHERE first_seen_at >= {I.AS_OF_SQL} - INTERVAL 7 DAY AND lifecycle_status IN ('new', 'active')
UNION ALL SELECT 'unreviewed', count(*) FROM page_review r JOIN active a ON a.id = r.page_id WHERE review_status = 'unreviewed'
UNION ALL SELECT 'worth_following', count(*) FROM page_review r JOIN active a ON a.id = r.page_id WHERE is_worth_following
UNION ALL SELECT 'recent_scans', 0""")
def dashboard_numbers(spark, sf):
    board = dashboard(PQ.state(spark, sf) | {"scan_runs": ST.scan_runs(spark, sf)}, I.AS_OF)
    count = F.count(F.lit(1)).alias("value")

    def unpivot(df):
        return df.unpivot([], df.columns, "number", "value")

    return (
        board["competitors"].agg(count).select(F.lit("competitors").alias("number"), "value")
        .unionByName(unpivot(board["new_pages"])).unionByName(unpivot(board["reviews"]))
        .unionByName(board["recent_scans"].agg(count).select(F.lit("recent_scans").alias("number"), "value"))
    )


@query("list_pages", f"""{PQ.LIST_SQL}, hit AS (SELECT * FROM listed WHERE review_status <> 'x' AND primary_keyword IS NOT NULL AND search_intent = 'informational')
SELECT * FROM (SELECT 'item' AS kind, id FROM hit ORDER BY first_seen_at DESC, id DESC LIMIT 20) UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM hit""")
def listed_and_total(spark, sf):
    found = list_pages(PQ.state(spark, sf), search_intent="informational")
    return found.items.select(F.lit("item").alias("kind"), "id").unionByName(
        found.total.select(F.lit("total").alias("kind"), F.col("total").cast("string").alias("id")))
