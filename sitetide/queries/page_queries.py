"""List, detail, metric and export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitetide.operators import metrics as M
from sitetide.operators import pages as P
from sitetide.operators import windows as W
from sitetide.operators.competitors import competitor_config, count_competitors, list_competitors
from sitetide.operators.fetches import apply_redirects
from sitetide.operators.joins import join_dimension
from sitetide.operators.windows import placed
from sitetide.queries import inputs as I
from sitetide.queries.registry import query
from sitetide.schemas import conform
from sitetide.session import shared_dir
from sitetide.sources.export import EXPORT_LIMIT, csv_header, export_lines, export_pages, read_export
from sitetide.sources.state_store import stored_tables, write_changes, write_state


def now():
    return F.lit(I.AS_OF).cast("timestamp")


def state(spark, sf):
    return {
        "pages": I.state_pages(spark, sf, every=None),
        "competitors": I.competitors(spark, sf),
        "page_seo_data": I.page_seo(spark, sf),
        "page_review": I.page_review(spark, sf),
        "page_analyses": I.page_analyses(spark, sf),
        "page_events": I.page_events(spark, sf),
    }


def listed(spark, sf, discovered=True):
    s = state(spark, sf)
    return P.page_list(
        s["pages"], s["competitors"], s["page_seo_data"], s["page_review"], s["page_analyses"],
        s["page_events"] if discovered else None)


LIST_SQL = f"""WITH {I.COMPETITORS_SQL}, {I.state_pages_sql(None)}, {I.PAGE_EVENTS_SQL}, {I.PAGE_ANALYSES_SQL}, {I.PAGE_REVIEW_SQL}, {I.PAGE_SEO_SQL},
all_pages AS (
  SELECT p.id, p.competitor_id, c.name AS competitor_name, p.current_url AS url, s.title, p.first_seen_at, p.lifecycle_status,
    s.fetch_status, l.status AS analysis_status, coalesce(nullif(r.manual_page_type, ''), l.page_type) AS page_type,
    coalesce(nullif(r.manual_primary_keyword, ''), l.primary_keyword) AS primary_keyword,
    coalesce(nullif(r.manual_search_intent, ''), l.search_intent) AS search_intent,
    coalesce(r.review_status, 'unreviewed') AS review_status, coalesce(r.is_viewed, FALSE) AS is_viewed,
    coalesce(r.is_worth_following, FALSE) AS is_worth_following
  FROM state_pages p JOIN competitors c ON c.id = p.competitor_id LEFT JOIN page_seo s ON s.page_id = p.id
  LEFT JOIN page_review r ON r.page_id = p.id LEFT JOIN latest l ON l.page_id = p.id WHERE NOT p.is_deleted),
listed AS (SELECT * FROM all_pages WHERE id IN (SELECT page_id FROM page_events WHERE event_type = 'discovered'))"""
LIST_COLS = f"""id, competitor_id, competitor_name, url, title, {I.stamp_sql('first_seen_at')} AS first_seen_at, lifecycle_status, fetch_status,
  analysis_status, page_type, primary_keyword, search_intent, review_status, is_viewed, is_worth_following"""


def shown(rows):
    return rows.withColumn("first_seen_at", I.stamp("first_seen_at"))


@query("page_list", f"{LIST_SQL} SELECT {LIST_COLS} FROM listed")
def page_list(spark, sf):
    return shown(listed(spark, sf))


@query("page_list_all", f"{LIST_SQL} SELECT {LIST_COLS} FROM all_pages")
def page_list_all(spark, sf):
    return shown(listed(spark, sf, discovered=False))


@query("page_list_filtered", f"""{LIST_SQL} SELECT {LIST_COLS} FROM listed
WHERE page_type = 'product' AND search_intent = 'commercial' AND review_status = 'unreviewed'
  AND first_seen_at >= TIMESTAMP '2024-01-02 00:00:00' AND first_seen_at <= TIMESTAMP '2024-01-25 05:00:00'""")
def page_list_filtered(spark, sf):
    return shown(P.filter_pages(
        listed(spark, sf), page_type="product", search_intent="commercial", review_status="unreviewed",
        date_from="2024-01-02T00:00:00Z", date_to="2024-01-25T05:00:00Z", competitor_id="", query=None))


@query("page_search", f"""{LIST_SQL} SELECT {LIST_COLS} FROM listed
WHERE translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_%'
  OR translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_%'
  OR translate(coalesce(primary_keyword, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_%'""")
def page_search(spark, sf):
    return shown(P.filter_pages(listed(spark, sf), query=" THE_ "))


@query("page_list_total", f"{LIST_SQL} SELECT count(*) AS total FROM listed WHERE review_status = 'unreviewed'")
def page_list_total(spark, sf):
    return P.count_pages(P.filter_pages(listed(spark, sf), review_status="unreviewed"))


@query("page_list_second_page", f"{LIST_SQL} SELECT {LIST_COLS} FROM listed ORDER BY listed.first_seen_at DESC, id DESC LIMIT 10 OFFSET 10")
def page_list_second_page(spark, sf):
    return shown(P.paginate(listed(spark, sf), page=2, page_size=10))


@query("page_list_next", f"{LIST_SQL} SELECT {LIST_COLS} FROM listed ORDER BY listed.first_seen_at DESC, id DESC LIMIT 150 OFFSET 14")
def page_list_next(spark, sf):
    """Behind the last row of the second page of seven; more rows than a page of the site shows."""
    rows = listed(spark, sf)
    return shown(P.next_page(rows, P.cursor_of(P.paginate(rows, page=2, page_size=7)), 150))


@query("list_by_competitor", f"""{LIST_SQL} SELECT competitor_id, count(*) AS pages, count(*) FILTER (is_worth_following) AS worth FROM listed GROUP BY 1""")
def list_by_competitor(spark, sf):
    return listed(spark, sf).groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("is_worth_following").alias("worth"))


@query("page_detail", f"""{LIST_SQL}
SELECT p.id, p.competitor_name, s.normalized_url, p.title, p.fetch_status, 0::BIGINT AS h2_count, l.status AS analysis_status, l.page_type AS inferred_type,
  p.review_status, p.is_viewed, r.manual_page_type, (SELECT least(count(*), 100) FROM page_events e WHERE e.page_id = p.id) AS events
FROM all_pages p JOIN state_pages s ON s.id = p.id LEFT JOIN latest l ON l.page_id = p.id LEFT JOIN page_review r ON r.page_id = p.id""")
def page_detail(spark, sf):
    detail, events = P.page_detail(state(spark, sf))
    counts = events.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    return detail.join(counts, "id", "left").select(
        "id", "competitor_name", "normalized_url", F.col("seo.title").alias("title"), F.col("seo.fetch_status").alias("fetch_status"),
        F.size("seo.h2").cast("bigint").alias("h2_count"), F.col("analysis.status").alias("analysis_status"),
        F.col("analysis.page_type").alias("inferred_type"), F.col("review.review_status").alias("review_status"),
        F.col("review.is_viewed").alias("is_viewed"), F.col("review.manual_page_type").alias("manual_page_type"),
        F.coalesce("events", F.lit(0)).alias("events"))


@query("latest_analysis", f"WITH {I.PAGE_ANALYSES_SQL} SELECT page_id, id, status, page_type, primary_keyword FROM latest")
def latest_analysis(spark, sf):
    return W.latest_analysis(I.page_analyses(spark, sf)).select("page_id", "id", "status", "page_type", "primary_keyword")


@query("timeline_top100", """
SELECT event_type AS page_id, CAST(event_id AS VARCHAR) AS id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) <= 100""")
def timeline_top100(spark, sf):
    kind = F.when(F.col("event_type") == "discovered", F.lit("signup")).otherwise(F.col("event_type"))
    return W.timeline(I.page_events(spark, sf).withColumn("page_id", kind)).select("page_id", "id")


@query("metrics_events", f"""
SELECT count(*) FILTER (ts >= date_trunc('day', {I.AS_OF_SQL} + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS today_new,
  count(*) FILTER (ts >= {I.AS_OF_SQL} - INTERVAL 7 DAY) AS seven_day_new FROM events WHERE event_type = 'signup'""")
def metrics_events(spark, sf):
    return M.metrics_events(I.page_events(spark, sf), now())


@query("metrics_status", f"""WITH {I.COMPETITORS_SQL}, {I.state_pages_sql(None)}
SELECT count(*) FILTER (first_seen_at >= date_trunc('day', {I.AS_OF_SQL}) AND lifecycle_status = 'new') AS today_new,
  count(*) FILTER (first_seen_at >= {I.AS_OF_SQL} - INTERVAL 7 DAY AND lifecycle_status IN ('new', 'active')) AS seven_day_new
FROM state_pages p JOIN competitors c ON c.id = p.competitor_id WHERE NOT p.is_deleted AND NOT c.is_deleted""")
def metrics_status(spark, sf):
    return M.metrics_status(I.state_pages(spark, sf, every=None), I.competitors(spark, sf), now())


@query("metrics_review", f"""WITH {I.COMPETITORS_SQL}, {I.state_pages_sql(None)}, {I.PAGE_REVIEW_SQL}
SELECT 'all' AS scope, count(*) FILTER (review_status = 'unreviewed') AS unreviewed, count(*) FILTER (is_worth_following) AS worth_following FROM page_review
UNION ALL SELECT 'active', count(*) FILTER (review_status = 'unreviewed'), count(*) FILTER (is_worth_following) FROM page_review r
JOIN state_pages p ON p.id = r.page_id JOIN competitors c ON c.id = p.competitor_id WHERE NOT p.is_deleted AND NOT c.is_deleted""")
def metrics_review(spark, sf):
    review = I.page_review(spark, sf)
    every = M.metrics_review(review).select(F.lit("all").alias("scope"), "*")
    active = M.metrics_review(review, I.state_pages(spark, sf, every=None), I.competitors(spark, sf))
    return every.unionByName(active.select(F.lit("active").alias("scope"), "*"))


@query("competitor_list", f"""WITH {I.COMPETITORS_SQL} SELECT id, name, domain, is_enabled, row_number() OVER (ORDER BY name, id) - 1 AS place
FROM competitors WHERE NOT is_deleted AND is_enabled""")
def competitor_list(spark, sf):
    """The order as well: the ordered rows lie in partitions that follow each other."""
    rows = list_competitors(I.competitors(spark, sf), enabled_only=True)
    return placed(rows).select("id", "name", "domain", "is_enabled", "place")


@query("competitor_count", f"WITH {I.COMPETITORS_SQL} SELECT count(*) AS competitors FROM competitors WHERE NOT is_deleted")
def competitor_count(spark, sf):
    return count_competitors(I.competitors(spark, sf))


@query("competitor_config", """WITH site AS (SELECT page_id // 100 AS n, count(*) AS pages FROM pages GROUP BY 1),
urls AS (SELECT page_id // 100 AS n, string_agg(url, ' ' ORDER BY page_id) AS urls FROM pages WHERE page_id % 2 = 1 GROUP BY 1)
SELECT 'site_' || site.n AS id, site.n % 3 <> 0 AS is_enabled, coalesce(urls.urls, '') AS manual_sitemap_urls
FROM site LEFT JOIN urls USING (n) WHERE site.n % 5 <> 4""")
def competitor_configuration(spark, sf):
    """Sites of one hundred pages each, all of them listed as manual sitemaps and half of those enabled."""
    pid, t = F.col("page_id"), F.timestamp_seconds(F.col("page_id"))
    number = F.expr("page_id DIV 100")
    site = F.concat(F.lit("site_"), number.cast("string"))
    pages = I.read(spark, sf, "pages").select("page_id", "url", site.alias("site"), number.alias("n"))
    sources = conform(pages.select(
        pid.cast("string").alias("id"), F.col("site").alias("competitor_id"), "url", F.col("url").alias("normalized_url"),
        F.lit("manual").alias("source_type"), (pid % 2 == 1).alias("is_enabled"), F.lit(False).alias("is_discovered"),
        t.alias("created_at"), t.alias("updated_at")), "sitemap_sources")
    created = F.timestamp_seconds(F.lit(0))
    sites = conform(pages.select("site", "n").distinct().select(
        F.col("site").alias("id"), F.col("site").alias("name"), F.col("site").alias("domain"), (F.col("n") % 3 != 0).alias("is_enabled"),
        F.lit(True).alias("baseline_established"), created.alias("created_at"), created.alias("updated_at"),
        F.when(F.col("n") % 5 == 4, created).alias("deleted_at")), "competitors")
    return competitor_config(sites, sources).select(
        "id", "is_enabled", F.array_join("manual_sitemap_urls", " ").alias("manual_sitemap_urls"))


def _cell(value: str) -> str:
    return (f"'\"' || replace(CASE WHEN regexp_matches({value}, '^{I.SPACES}*[=+@-]') THEN '''' || {value} ELSE {value} END, '\"', '\"\"') || '\"'")


CSV_VALUES = [
    "strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.000Z')", "competitor_name", "url", "coalesce(title, '')", "lifecycle_status",
    "coalesce(fetch_status, '')", "coalesce(analysis_status, '')", "coalesce(page_type, '')", "coalesce(primary_keyword, '')",
    "coalesce(search_intent, '')", "review_status", "CASE WHEN is_worth_following THEN 'yes' ELSE 'no' END",
]


@query("csv_export", f"""{LIST_SQL},
newest AS (SELECT * FROM all_pages ORDER BY first_seen_at DESC, id DESC LIMIT 5000)
SELECT chr(65279) || '{csv_header()}' AS line UNION ALL SELECT {" || ',' || ".join(_cell(v) for v in CSV_VALUES)} FROM newest""")
def csv_export(spark, sf):
    return export_lines(listed(spark, sf, discovered=False), EXPORT_LIMIT).select("line")


@query("csv_first_page", f"""{LIST_SQL},
newest AS (SELECT *, row_number() OVER (ORDER BY first_seen_at DESC, id DESC) AS line_no FROM listed)
SELECT 0 AS line_no, chr(65279) || '{csv_header()}' AS line UNION ALL SELECT line_no, {" || ',' || ".join(_cell(v) for v in CSV_VALUES)} FROM newest WHERE line_no <= 20""")
def csv_first_page(spark, sf):
    """The newest twenty lines with their numbers."""
    return export_lines(listed(spark, sf), 20)


@query("csv_written", f"""{LIST_SQL},
lines AS (SELECT 0 AS n, chr(65279) || '{csv_header()}' AS line UNION ALL
  SELECT row_number() OVER (ORDER BY first_seen_at DESC, id DESC), {" || ',' || ".join(_cell(v) for v in CSV_VALUES)} FROM all_pages)
SELECT n + 1 AS n, line, (SELECT sum(strlen(line) + 2) FROM lines)::BIGINT AS file_bytes FROM lines""")
def csv_written(spark, sf):
    """Export all pages, then read the files' bytes back: lines with their place, and the bytes that were written."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export_pages(listed(spark, sf, discovered=False), path)
    files = read_export(spark, path)
    size = files.agg(F.sum(F.length("content"))).first()[0]
    lines = files.select("file", F.posexplode(F.split(F.col("content").cast("string"), "\r\n", -1)).alias("at", "line")).filter("line <> ''")
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file").agg(F.count(F.lit(1)).alias("m")).select("file", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(before), "file").select(
        (F.col("before") + F.col("at") + 1).alias("n"), "line", F.lit(size).cast("bigint").alias("file_bytes"))


@query("state_written", f"""WITH {I.COMPETITORS_SQL}, {I.state_pages_sql(None)}
SELECT id, CASE WHEN page_id < 10 THEN 'moved' ELSE current_url END AS current_url, lifecycle_status, competitor_id IN (SELECT id FROM competitors WHERE is_deleted) AS gone FROM state_pages""")
def state_written(spark, sf):
    """Write the state, read it back, apply ten redirects, write what they change, and read the pages again."""
    root = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    write_state({name: conform(df, name) for name, df in state(spark, sf).items()}, root, buckets=16)
    stored = stored_tables(spark, root)
    ten = stored["pages"].filter(F.col("id").cast("bigint") < 10)
    results = ten.select(F.col("id").alias("page_id"), F.lit("success").alias("fetch_status"), F.lit("moved").alias("final_url"),
                         F.array("current_url").alias("redirect_chain"))
    moved, _ = apply_redirects(ten, results, now())
    write_changes({"pages": moved}, root)
    after = stored_tables(spark, root)
    gone = after["competitors"].filter("deleted_at IS NOT NULL").select(F.col("id").alias("competitor_id"), F.lit(True).alias("gone"))
    return join_dimension(after["pages"], gone, ["competitor_id"], ["id"], "left").select(
        "id", "current_url", "lifecycle_status", F.coalesce("gone", F.lit(False)).alias("gone"))
