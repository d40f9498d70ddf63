"""Views over the driver tables that play the role of landed and state tables.

Each is defined twice: as a DataFrame here and as SQL text for the cross-check, from the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-20T12:00:00Z"
AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(url: str = "url") -> Column:
    return F.regexp_extract(F.col(url), "^https?://([^/?#]+)", 1)


HOST_SQL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def norm_sql(url: str) -> str:
    """SQL restatement of the URL normalization for the plain URLs of the test data."""
    part = f"regexp_extract({url}, '^(?i)(https?)://([^/?#]+)([^?#]*)[?]?([^#]*)', ['s', 'h', 'p', 'q'])"
    path = f"regexp_replace({part}.p, '/{{2,}}', '/', 'g')"
    params = (
        f"array_to_string(list_sort(list_filter(string_split({part}.q, '&'), lambda x: x <> '' and "
        "not regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)'))), '&')"
    )
    return (
        f"(lower({part}.s) || '://' || "
        f"regexp_replace(lower({part}.h), CASE WHEN lower({part}.s) = 'http' THEN ':80$' ELSE ':443$' END, '') || "
        f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END || "
        f"CASE WHEN {params} = '' THEN '' ELSE '?' || {params} END)"
    )


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL in five spellings."""
    url = F.col("url")
    tracked = F.when(F.contains(url, F.lit("#")), F.replace(url, F.lit("#"), F.lit("?utm_medium=x&b=2&a=1#")))
    variants = F.array(
        url,
        F.concat(F.upper(F.regexp_extract("url", "^(https?://[^/]+)", 1)), F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)),
        F.regexp_replace("url", "^(https?://[^/]+)/", "$1//"),
        F.coalesce(tracked, F.when(F.contains(url, F.lit("?")), F.concat(url, F.lit("&gclid=9&b=1")))
                   .otherwise(F.concat(url, F.lit("?UTM_Campaign=z&b=2&a=1")))),
        F.when(F.startswith(url, F.lit("https")), F.regexp_replace("url", "^(https://[^/]+)", "$1:443"))
        .otherwise(F.regexp_replace("url", "^(http://[^/]+)", "$1:80")),
    )
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.posexplode(variants).alias("variant", "url")).withColumn(
        "variant", F.col("variant").cast("bigint"))


VARIANTS_SQL = """
  v AS (
    SELECT page_id, 0::BIGINT AS variant, url FROM pages
    UNION ALL SELECT page_id, 1, upper(regexp_extract(url, '^(https?://[^/]+)', 1)) || regexp_extract(url, '^https?://[^/]+(.*)$', 1) FROM pages
    UNION ALL SELECT page_id, 2, regexp_replace(url, '^(https?://[^/]+)/', '\\1//') FROM pages
    UNION ALL SELECT page_id, 3, CASE WHEN contains(url, '#') THEN replace(url, '#', '?utm_medium=x&b=2&a=1#')
        WHEN contains(url, '?') THEN url || '&gclid=9&b=1' ELSE url || '?UTM_Campaign=z&b=2&a=1' END FROM pages
    UNION ALL SELECT page_id, 4, CASE WHEN starts_with(url, 'https') THEN regexp_replace(url, '^(https://[^/]+)', '\\1:443')
        ELSE regexp_replace(url, '^(http://[^/]+)', '\\1:80') END FROM pages
  )"""


# --- pages as state: existing snapshot and current scan --------------------------------------------


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One competitor per host."""
    t = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    hosts = read(spark, sf_dir, "pages").select(host().alias("id")).distinct()
    return hosts.select(
        "id",
        F.upper("id").alias("name"),
        F.col("id").alias("domain"),
        (F.length("id") % 5 != 0).alias("is_enabled"),
        F.lit(True).alias("baseline_established"),
        F.lit(None).cast("string").alias("last_scan_status"),
        F.lit(None).cast("timestamp").alias("last_scanned_at"),
        t.alias("created_at"),
        t.alias("updated_at"),
        F.when(F.length("id") % 7 == 0, t).alias("deleted_at"),
    )


COMPETITORS_SQL = f"""
  competitors AS (
    SELECT DISTINCT {HOST_SQL} AS id, upper({HOST_SQL}) AS name, {HOST_SQL} AS domain,
      length({HOST_SQL}) % 5 <> 0 AS is_enabled, length({HOST_SQL}) % 7 = 0 AS is_deleted
    FROM pages
  )"""


def state_pages(spark: SparkSession, sf_dir: str, every: int | None = 5) -> DataFrame:
    """Known pages: four of five driver pages, with a lifecycle status from the page id."""
    from sitetide.functions.urls import normalize_url

    pid = F.col("page_id")
    status = (
        F.when(pid % 4 == 0, F.lit("baseline")).when(pid % 4 == 1, F.lit("active")).when(pid % 4 == 2, F.lit("new"))
        .otherwise(F.lit("missing"))
    )
    seen = F.timestamp_seconds(F.lit(1704067200) + (pid % 720) * 3600)
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    if every:
        pages = pages.filter(pid % every != 0)
    return pages.select(
        pid.cast("string").alias("id"),
        host().alias("competitor_id"),
        F.col("url").alias("original_url"),
        normalize_url("url").alias("normalized_url"),
        F.col("url").alias("current_url"),
        status.alias("lifecycle_status"),
        F.when(pid % 4 == 3, F.lit(2)).otherwise((pid % 2).cast("int")).alias("missing_streak"),
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
        F.lit(None).cast("string").alias("sitemap_lastmod"),
        F.lit("scan_0").alias("first_scan_run_id"),
        F.lit("scan_0").alias("last_scan_run_id"),
        seen.alias("created_at"),
        seen.alias("updated_at"),
        F.when(pid % 11 == 0, seen).alias("deleted_at"),
    )


def state_pages_sql(every: int | None = 5) -> str:
    where = f"WHERE page_id % {every} <> 0" if every else ""
    return f"""
  state_pages AS (
    SELECT page_id, CAST(page_id AS VARCHAR) AS id, {HOST_SQL} AS competitor_id, url AS current_url,
      {norm_sql('url')} AS normalized_url,
      CASE page_id % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'active' WHEN 2 THEN 'new' ELSE 'missing' END AS lifecycle_status,
      CASE WHEN page_id % 4 = 3 THEN 2 ELSE page_id % 2 END AS missing_streak,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id % 720 AS INTEGER)) AS first_seen_at,
      page_id % 11 = 0 AS is_deleted
    FROM pages {where}
  )"""


def current_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new scan: six of seven driver pages."""
    from sitetide.functions.urls import normalize_url

    pages = read(spark, sf_dir, "pages").select("page_id", "url").filter(F.col("page_id") % 7 != 0)
    return pages.select(
        host().alias("competitor_id"),
        normalize_url("url").alias("normalized_url"),
        "url",
        F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")).alias("lastmod"),
        F.concat(F.lit("https://"), host(), F.lit("/sitemap-"), (F.col("page_id") % 3).cast("string"), F.lit(".xml")).alias("source_url"),
    )


CURRENT_SQL = f"""
  current_entries AS (
    SELECT page_id, {HOST_SQL} AS competitor_id, {norm_sql('url')} AS normalized_url, url,
      '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod,
      'https://' || {HOST_SQL} || '/sitemap-' || CAST(page_id % 3 AS VARCHAR) || '.xml' AS source_url
    FROM pages WHERE page_id % 7 <> 0
  )"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per host; hosts whose length is a multiple of three were scanned incompletely."""
    hosts = read(spark, sf_dir, "pages").select(host().alias("competitor_id")).distinct()
    return hosts.select(
        "competitor_id",
        F.concat(F.lit("scan_"), "competitor_id").alias("scan_run_id"),
        (F.length("competitor_id") % 3 != 0).alias("is_complete"),
    )


SCANS_SQL = f"""
  scans AS (
    SELECT DISTINCT {HOST_SQL} AS competitor_id, 'scan_' || {HOST_SQL} AS scan_run_id,
      length({HOST_SQL}) % 3 <> 0 AS is_complete
    FROM pages
  )"""

DIFF_SQL = f"""
  known AS (SELECT * FROM state_pages WHERE NOT is_deleted),
  diff AS (
    SELECT coalesce(c.competitor_id, k.competitor_id) AS competitor_id,
      coalesce(c.normalized_url, k.normalized_url) AS normalized_url, k.id AS page_id, c.url, c.lastmod, s.scan_run_id,
      CASE WHEN c.url IS NOT NULL AND k.id IS NULL AND s.is_complete THEN 'new'
        WHEN c.url IS NOT NULL AND k.lifecycle_status = 'missing' THEN 'reappeared'
        WHEN c.url IS NOT NULL AND k.id IS NOT NULL THEN 'present'
        WHEN c.url IS NULL AND s.is_complete AND k.lifecycle_status <> 'missing' AND k.missing_streak + 1 >= 2 THEN 'confirmed_missing'
        WHEN c.url IS NULL AND s.is_complete AND k.lifecycle_status <> 'missing' THEN 'first_missing' END AS change_type
    FROM current_entries c
    FULL OUTER JOIN known k ON c.competitor_id = k.competitor_id AND c.normalized_url = k.normalized_url
    JOIN scans s ON s.competitor_id = coalesce(c.competitor_id, k.competitor_id)
  )"""


# --- events, analyses, reviews ---------------------------------------------------------------------


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("page_id"),
        F.lit(None).cast("string").alias("scan_run_id"),
        F.when(F.col("event_type") == "signup", F.lit("discovered")).otherwise(F.col("event_type")).alias("event_type"),
        F.lit(None).cast("string").alias("old_value_json"),
        F.col("props").alias("new_value_json"),
        ts.alias("detected_at"),
        ts.alias("created_at"),
    )


PAGE_EVENTS_SQL = """
  page_events AS (
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS page_id,
      CASE WHEN event_type = 'signup' THEN 'discovered' ELSE event_type END AS event_type, props, ts AS detected_at
    FROM events
  )"""

# Fixed lists the inferred values cycle through.
PAGE_TYPE_CYCLE = ["product", "blog", "guide"]
INTENT_CYCLE = ["commercial", "informational"]


def page_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") == "purchase"
    ts = F.col("ts").cast("timestamp")
    eid = F.col("event_id")
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return events.select(
        eid.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("page_id"),
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.lit("rules").alias("provider"),
        F.lit("m").alias("model"),
        F.lit("v1").alias("prompt_version"),
        F.when(ok, F.element_at(F.array(*map(F.lit, PAGE_TYPE_CYCLE)), (eid % 3 + 1).cast("int"))).alias("page_type"),
        F.when(ok, F.lit("topic")).alias("primary_topic"),
        F.when(ok, F.concat(F.lit("Keyword "), (eid % 50).cast("string"))).alias("primary_keyword"),
        F.array().cast("array<string>").alias("secondary_keywords"),
        F.when(ok, F.element_at(F.array(*map(F.lit, INTENT_CYCLE)), (eid % 2 + 1).cast("int"))).alias("search_intent"),
        F.lit(None).cast("string").alias("product_line"),
        F.when(ok, F.lit("s")).alias("summary"),
        F.array().cast("array<string>").alias("evidence"),
        F.when(ok, F.lit(0.5)).alias("confidence"),
        F.lit(None).cast("string").alias("raw_response_excerpt"),
        F.when(~ok, F.lit("AI_REQUEST_FAILED")).alias("error_code"),
        F.when(~ok, F.lit("x")).alias("error_message"),
        F.when(ok, ts).alias("analyzed_at"),
        ts.alias("created_at"),
    )


PAGE_ANALYSES_SQL = """
  page_analyses AS (
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS page_id,
      CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS status, ts AS happened,
      CASE WHEN event_type = 'purchase' THEN ['product', 'blog', 'guide'][event_id % 3 + 1] END AS page_type,
      CASE WHEN event_type = 'purchase' THEN 'Keyword ' || CAST(event_id % 50 AS VARCHAR) END AS primary_keyword,
      CASE WHEN event_type = 'purchase' THEN ['commercial', 'informational'][event_id % 2 + 1] END AS search_intent
    FROM events WHERE event_type IN ('purchase', 'error')
  ),
  latest AS (
    SELECT * FROM page_analyses QUALIFY row_number() OVER (
      PARTITION BY page_id ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, happened DESC, id DESC) = 1
  )"""


def page_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    did = F.col("doc_id")
    worth = (F.col("quality") == 1) & (F.col("toxic") == 0)
    status = (
        F.when(worth, F.lit("worth_following")).when(F.col("toxic") == 1, F.lit("not_relevant"))
        .otherwise(F.lit("unreviewed"))
    )
    t = F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    return read(spark, sf_dir, "labels").select(
        did.cast("string").alias("page_id"),
        status.alias("review_status"),
        (did % 2 == 0).alias("is_viewed"),
        worth.alias("is_worth_following"),
        F.when(did % 6 == 0, F.lit("landing_page")).when(did % 6 == 1, F.lit("")).alias("manual_page_type"),
        F.when(did % 9 == 0, F.concat(F.lit("Manual "), did.cast("string"))).alias("manual_primary_keyword"),
        F.array().cast("array<string>").alias("manual_secondary_keywords"),
        F.when(did % 10 == 0, F.lit("mixed")).alias("manual_search_intent"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        t.alias("created_at"),
        t.alias("updated_at"),
    )


PAGE_REVIEW_SQL = """
  page_review AS (
    SELECT CAST(doc_id AS VARCHAR) AS page_id, doc_id,
      CASE WHEN quality = 1 AND toxic = 0 THEN 'worth_following' WHEN toxic = 1 THEN 'not_relevant' ELSE 'unreviewed' END AS review_status,
      doc_id % 2 = 0 AS is_viewed, quality = 1 AND toxic = 0 AS is_worth_following,
      CASE WHEN doc_id % 6 = 0 THEN 'landing_page' WHEN doc_id % 6 = 1 THEN '' END AS manual_page_type,
      CASE WHEN doc_id % 9 = 0 THEN 'Manual ' || CAST(doc_id AS VARCHAR) END AS manual_primary_keyword,
      CASE WHEN doc_id % 10 = 0 THEN 'mixed' END AS manual_search_intent
    FROM labels
  )"""


def page_seo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEO snapshot of the driver pages: title from the HTML, fetch status from the page id."""
    from sitetide.functions.html import first_tag_text

    pid = F.col("page_id")
    pages = read(spark, sf_dir, "pages").filter(pid % 3 != 0)
    status = F.when(pid % 8 == 1, F.lit("failed")).otherwise(F.lit("success"))
    t = F.lit("2024-01-06T00:00:00Z").cast("timestamp")
    strings = F.lit(None).cast("string")
    return pages.select(
        pid.cast("string").alias("page_id"),
        F.lit(200).alias("http_status"),
        F.col("url").alias("final_url"),
        F.array().cast("array<string>").alias("redirect_chain"),
        F.lit("text/html").alias("content_type"),
        first_tag_text("html", "title").alias("title"),
        strings.alias("meta_description"),
        strings.alias("h1"),
        F.array().cast("array<string>").alias("h2"),
        strings.alias("canonical_url"),
        strings.alias("robots_meta"),
        F.lit("en").alias("page_language"),
        F.concat(F.lit("text "), pid.cast("string")).alias("content_excerpt"),
        strings.alias("content_hash"),
        status.alias("fetch_status"),
        F.when(pid % 8 == 1, F.lit("HTTP 500")).alias("fetch_error"),
        t.alias("fetched_at"),
        t.alias("updated_at"),
    )


SPACES = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def clean_sql(text: str) -> str:
    """Tags out, named references decoded (ampersand last), white space collapsed."""
    out = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{entity};', '{char}')"
    return f"trim(regexp_replace({out}, '{SPACES}+', ' ', 'g'))"


PAGE_SEO_SQL = f"""
  page_seo AS (
    SELECT CAST(page_id AS VARCHAR) AS page_id, page_id AS pid,
      nullif({clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title,
      CASE WHEN page_id % 8 = 1 THEN 'failed' ELSE 'success' END AS fetch_status
    FROM pages WHERE page_id % 3 <> 0
  )"""
