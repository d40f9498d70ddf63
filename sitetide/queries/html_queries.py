"""SEO extraction and page fetch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.functions import html as H
from sitetide.operators import fetches as P
from sitetide.operators.redirects import latest_responses, resolve_redirects
from sitetide.queries import inputs as I
from sitetide.queries.registry import query


def html_pages(spark, sf):
    """Driver pages with description, robots, canonical and h2 elements put after the title."""
    pid = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("</title><meta name='Description' content=\"About &lt;"), pid, F.lit("&gt;\"><META NAME=robots CONTENT="),
        F.when(F.col("page_id") % 2 == 0, F.lit("noindex")).otherwise(F.lit("''")),
        F.lit("><link rel='alternate CANONICAL' href='/c/"), pid, F.lit("?x=1'><h2>Part <i>"), pid, F.lit("</i></h2><h2> </h2><h2>End</h2>"))
    return I.read(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</title>"), extra))


HTML_SQL = """
  html_pages AS (
    SELECT page_id, url, replace(html, '</title>', '</title><meta name=''Description'' content="About &lt;' || page_id || '&gt;"><META NAME=robots CONTENT='
      || CASE WHEN page_id % 2 = 0 THEN 'noindex' ELSE '''''' END || '><link rel=''alternate CANONICAL'' href=''/c/' || page_id
      || '?x=1''><h2>Part <i>' || page_id || '</i></h2><h2> </h2><h2>End</h2>') AS html
    FROM pages)"""

TITLE_SQL = f"""nullif({I.clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')"""
H1_SQL = f"""nullif({I.clean_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '')"""
LANG_SQL = "nullif(regexp_extract(html, '(?i)<html[^>]*lang\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), '')"
HIDDEN_SQL = "|".join(f"<{t}\\b.*?</{t}>" for t in H.HIDDEN_BLOCKS.split("|"))
CHROME_SQL = "|".join(f"<{t}\\b.*?</{t}>" for t in H.CHROME_BLOCKS.split("|"))
STRIPPED_SQL = f"regexp_replace(regexp_replace(html, '(?is){HIDDEN_SQL}', ' ', 'g'), '(?is){CHROME_SQL}', ' ', 'g')"
TEXT_SQL = I.clean_sql(STRIPPED_SQL)


@query("seo_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def seo_title(spark, sf):
    return I.read(spark, sf, "pages").select("page_id", H.first_tag_text("html", "title").alias("title"))


@query("seo_headings", f"""
WITH {HTML_SQL} SELECT page_id, {H1_SQL} AS h1, 'Part ' || page_id || '|End' AS h2 FROM html_pages""")
def seo_headings(spark, sf):
    return html_pages(spark, sf).select(
        "page_id", H.first_tag_text("html", "h1").alias("h1"),
        F.array_join(H.all_tag_text("html", "h2", H.H2_STORED), "|").alias("h2"))


@query("seo_meta", f"""
WITH {HTML_SQL} SELECT page_id, 'About <' || page_id || '>' AS description,
  CASE WHEN page_id % 2 = 0 THEN 'noindex' END AS robots, '/c/' || page_id || '?x=1' AS canonical FROM html_pages""")
def seo_meta(spark, sf):
    return html_pages(spark, sf).select(
        "page_id", H.meta_content("html", "description").alias("description"),
        H.meta_content("html", "robots").alias("robots"), H.link_href("html", "canonical").alias("canonical"))


@query("seo_lang", f"SELECT page_id, {LANG_SQL} AS page_language FROM pages")
def seo_lang(spark, sf):
    return I.read(spark, sf, "pages").select("page_id", H.html_lang("html").alias("page_language"))


@query("seo_visible_text", f"""
SELECT page_id, md5({TEXT_SQL}) AS text_md5, length({TEXT_SQL}) AS chars FROM pages""")
def seo_visible_text(spark, sf):
    text = I.read(spark, sf, "pages").select("page_id", H.visible_text("html").alias("text"))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("decode_entities", """
SELECT doc_id, md5(text || ' <A> & é &bogus; ') AS decoded FROM documents""")
def decode_entities(spark, sf):
    tail = F.lit(" &lt;&#65;&GT; &#x26; &#233; &bogus;&nbsp;")
    docs = I.read(spark, sf, "documents").select(
        "doc_id", F.concat(F.replace("text", F.lit("&"), F.lit("&amp;")), tail).alias("encoded"))
    return docs.select("doc_id", F.md5(H.decode_entities("encoded")).alias("decoded"))


@query("seo_page", f"""
WITH {HTML_SQL}
SELECT page_id, {TITLE_SQL} AS title, {H1_SQL} AS h1, 'Part ' || page_id || '|End' AS h2, 'About <' || page_id || '>' AS meta_description,
  CASE WHEN page_id % 2 = 0 THEN 'noindex' END AS robots_meta,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/c/' || page_id || '?x=1' AS canonical_url, {LANG_SQL} AS page_language,
  md5({TEXT_SQL}) AS excerpt_md5
FROM html_pages""")
def seo_page(spark, sf):
    return H.extract_seo(html_pages(spark, sf)).select(
        "page_id", "title", "h1", F.array_join("h2", "|").alias("h2"), "meta_description", "robots_meta", "canonical_url",
        "page_language", F.md5("content_excerpt").alias("excerpt_md5"))


@query("seo_excerpt", f"""
SELECT page_id, md5(substr({TEXT_SQL}, 1, 200)) AS excerpt_md5, length(substr({TEXT_SQL}, 1, 200)) AS chars FROM pages""")
def seo_excerpt(spark, sf):
    """The first 200 characters of the visible text."""
    excerpt = I.read(spark, sf, "pages").select("page_id", H.content_excerpt("html", 200).alias("e"))
    return excerpt.select("page_id", F.md5("e").alias("excerpt_md5"), F.length("e").cast("bigint").alias("chars"))


def landed_pages(spark, sf):
    """Landed responses of all driver pages; status, type and size problems follow from the page id."""
    pid = F.col("page_id")
    return I.read(spark, sf, "pages").select(
        pid.cast("string").alias("page_id"),
        F.concat(F.lit("scan_"), (pid % 3).cast("string")).alias("scan_run_id"),
        F.col("url"),
        I.host().alias("domain"),
        F.col("url").alias("final_url"),
        F.when(pid % 12 == 9, F.array(F.col("url"))).otherwise(F.array().cast("array<string>")).alias("redirect_chain"),
        F.when(pid % 12 == 1, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(pid % 12 == 3, F.lit("application/pdf")).when(pid % 12 == 5, F.lit(None).cast("string"))
        .otherwise(F.lit("Text/HTML; charset=utf-8")).alias("content_type"),
        F.when(pid % 12 == 7, F.lit("1500001")).alias("content_length"),
        F.col("html").alias("body"),
        F.when(pid % 12 == 11, F.lit("OUTBOUND_REDIRECT_LIMIT")).alias("error_code"),
        F.when(pid % 12 == 11, F.lit("More than 5 redirects")).when(pid % 24 == 2, F.lit("AbortError")).alias("error"),
    )


OUTCOME_SQL = """
  outcome AS (
    SELECT CAST(page_id AS VARCHAR) AS page_id, page_id AS pid, url, html, 'scan_' || (page_id % 3) AS scan_run_id,
      CASE WHEN page_id % 24 = 2 THEN 'PAGE_FETCH_TIMEOUT' ELSE CASE page_id % 12 WHEN 11 THEN 'PAGE_REDIRECT_LIMIT' WHEN 1 THEN 'PAGE_HTTP_ERROR' WHEN 3 THEN 'PAGE_UNSUPPORTED_CONTENT_TYPE'
        WHEN 5 THEN 'PAGE_UNSUPPORTED_CONTENT_TYPE' WHEN 7 THEN 'PAGE_RESPONSE_TOO_LARGE' END END AS code,
      CASE WHEN page_id % 24 = 2 THEN 'AbortError' ELSE CASE page_id % 12 WHEN 11 THEN 'More than 5 redirects' WHEN 1 THEN 'HTTP 404'
        WHEN 3 THEN 'Unsupported content type: application/pdf' WHEN 5 THEN 'Missing content type'
        WHEN 7 THEN 'Response exceeds 1500000 bytes' END END AS message
    FROM pages
  ),
  fetched AS (SELECT *, CASE WHEN code IS NULL THEN 'success' WHEN code = 'PAGE_UNSUPPORTED_CONTENT_TYPE' THEN 'unsupported' ELSE 'failed' END AS fetch_status,
      CASE WHEN pid % 24 = 2 OR pid % 12 = 7 THEN NULL WHEN pid % 12 = 1 THEN 404 ELSE 200 END::BIGINT AS http_status
    FROM outcome)"""


@query("fetch_outcome", f"WITH {OUTCOME_SQL} SELECT page_id, fetch_status, code, message, http_status FROM fetched")
def fetch_outcome(spark, sf):
    return P.fetch_outcome(landed_pages(spark, sf), P.PAGE_MAX_BYTES).select(
        "page_id", "fetch_status", "code", "message", F.col("http_status").cast("bigint").alias("http_status"))


@query("fetch_results", f"""
WITH {OUTCOME_SQL}
SELECT page_id, fetch_status, CASE WHEN fetch_status = 'success' THEN {TITLE_SQL} END AS title,
  CASE WHEN fetch_status = 'success' THEN md5({TEXT_SQL}) END AS excerpt_md5, 0::BIGINT AS h2_count,
  CASE WHEN fetch_status = 'success' THEN 'Text/HTML; charset=utf-8' WHEN pid % 12 = 3 THEN 'application/pdf' END AS content_type
FROM fetched""")
def fetch_results(spark, sf):
    return P.fetch_results(landed_pages(spark, sf), P.PAGE_MAX_BYTES).select(
        "page_id", "fetch_status", "title", F.md5("content_excerpt").alias("excerpt_md5"),
        F.size("h2").cast("bigint").alias("h2_count"), "content_type")


@query("body_limit", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR strlen(text) > 3000 THEN 'Response exceeds 3000 bytes' END AS error,
  CASE WHEN doc_id % 5 = 0 OR strlen(text) > 3000 THEN 0 ELSE strlen(text) END::BIGINT AS kept_bytes FROM documents""")
def body_limit(spark, sf):
    from sitetide.sources.tables import body_limit as limit

    docs = I.read(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("body"), F.when(F.col("doc_id") % 5 == 0, F.lit(" 3001 ")).alias("content_length"),
        F.lit(None).cast("string").alias("error"))
    return limit(docs, 3000).select(
        "doc_id", "error", F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("kept_bytes"))


@query("fetch_upsert", f"""
WITH {OUTCOME_SQL}, {I.PAGE_SEO_SQL}
SELECT f.page_id, f.fetch_status, f.http_status, f.message AS fetch_error,
  CASE WHEN f.fetch_status = 'success' THEN {TITLE_SQL} ELSE s.title END AS title
FROM fetched f LEFT JOIN page_seo s USING (page_id)""")
def fetch_upsert(spark, sf):
    results = P.fetch_results(landed_pages(spark, sf), P.PAGE_MAX_BYTES)
    after = P.upsert_fetch(I.page_seo(spark, sf), results, F.lit(I.AS_OF).cast("timestamp"))
    return after.select(
        "page_id", "fetch_status", F.col("http_status").cast("bigint").alias("http_status"), "fetch_error", "title")


@query("fetch_effects", f"""
WITH {OUTCOME_SQL}
SELECT page_id, 'event:fetch_failed' AS effect, '{{"code":"' || code || '","message":"' || message || '"}}' AS detail FROM fetched WHERE fetch_status <> 'success'
UNION ALL SELECT page_id, 'event:redirected', '{{"finalUrl":"' || url || '","chain":["' || url || '"]}}' FROM fetched WHERE pid % 12 = 9
UNION ALL SELECT page_id, 'attempt:' || fetch_status, coalesce(code, '') FROM fetched""")
def fetch_effects(spark, sf):
    as_of = F.lit(I.AS_OF).cast("timestamp")
    results = P.fetch_results(landed_pages(spark, sf), P.PAGE_MAX_BYTES)
    _, moved = P.apply_redirects(I.state_pages(spark, sf, every=None), results, as_of)
    events = moved.unionByName(P.failure_events(results, as_of)).select(
        "page_id", F.concat(F.lit("event:"), "event_type").alias("effect"), F.col("new_value_json").alias("detail"))
    log = P.fetch_log(results, as_of).select(
        "page_id", F.concat(F.lit("attempt:"), "status").alias("effect"), F.coalesce("error_code", F.lit("")).alias("detail"))
    return events.unionByName(log)


@query("apply_redirects", f"""
WITH {I.state_pages_sql(None)} SELECT id, current_url, CASE WHEN page_id % 12 = 9 THEN '2024-01-20 12:00:00'
  ELSE {I.stamp_sql('first_seen_at')} END AS updated_at FROM state_pages""")
def apply_redirects(spark, sf):
    results = P.fetch_outcome(landed_pages(spark, sf), P.PAGE_MAX_BYTES)
    pages, _ = P.apply_redirects(I.state_pages(spark, sf, every=None), results, F.lit(I.AS_OF).cast("timestamp"))
    return pages.select("id", "current_url", I.stamp("updated_at").alias("updated_at"))


@query("clip_excerpts", """
SELECT doc_id, md5(substr(text, 1, 8000)) AS excerpt_md5, length(text) > 8000 AS clipped FROM documents""")
def clip_excerpts(spark, sf):
    docs = I.read(spark, sf, "documents").select("doc_id", F.col("text").alias("content_excerpt"), F.length("text").alias("n"))
    return P.clip_excerpts(docs).select("doc_id", F.md5("content_excerpt").alias("excerpt_md5"), (F.col("n") > 8000).alias("clipped"))


@query("redirect_chain", """
WITH RECURSIVE hop AS (
  SELECT o_orderkey AS start_key, o_orderkey AS at_key, 0 AS hops FROM orders
  UNION ALL SELECT h.start_key, h.at_key + 1, h.hops + 1 FROM hop h JOIN orders o ON o.o_orderkey = h.at_key
  WHERE h.at_key % 8 < 6 AND h.hops < 6),
last AS (SELECT start_key, max(hops) AS hops FROM hop GROUP BY 1)
SELECT start_key AS order_key,
  'https://shop.example.com/o/' || CASE WHEN hops > 5 OR start_key + hops NOT IN (SELECT o_orderkey FROM orders) THEN start_key
    ELSE start_key + hops END AS final_url,
  CASE WHEN hops > 5 OR start_key + hops NOT IN (SELECT o_orderkey FROM orders) THEN 0 ELSE hops END::BIGINT AS redirects,
  CASE WHEN hops > 5 THEN 'OUTBOUND_REDIRECT_LIMIT' WHEN start_key + hops NOT IN (SELECT o_orderkey FROM orders) THEN 'NOT_LANDED' END AS error_code
FROM last""")
def redirect_chain(spark, sf):
    key = F.col("o_orderkey")
    page = F.lit("https://shop.example.com/o/")
    moves = key % 8 < 6
    none = F.lit(None).cast("string")
    orders = I.read(spark, sf, "orders").select("o_orderkey")
    responses = orders.select(
        F.concat(page, key.cast("string")).alias("url"),
        F.when(moves, F.lit(301)).otherwise(F.lit(200)).alias("status"),
        F.when(moves, F.concat(F.lit("/o/"), (key + 1).cast("string"))).alias("location"),
        F.lit("text/html").alias("content_type"), none.alias("content_length"), none.alias("body"), none.alias("error"))
    requests = orders.select(
        key.alias("order_key"), F.concat(page, key.cast("string")).alias("url"), F.lit("example.com").alias("domain"))
    return resolve_redirects(requests, responses).select(
        "order_key", "final_url", F.size("redirect_chain").cast("bigint").alias("redirects"), "error_code")


@query("landed_latest", """
WITH landed AS (
  SELECT page_id, url, n % 2 AS owner, 200 + n AS status, (page_id * 7 + n * 13) % 29 AS moment FROM pages, range(5) r(n))
SELECT 'c' || owner AS competitor_id, url, status::BIGINT AS status FROM landed
QUALIFY row_number() OVER (PARTITION BY owner, url ORDER BY moment DESC, status) = 1""")
def landed_latest(spark, sf):
    """Every page landed five times, by two competitors in turns and out of order; the newest response of each counts."""
    n, pid = F.col("n"), F.col("page_id")
    rows = I.read(spark, sf, "pages").select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).select(
        F.concat(F.lit("c"), (n % 2).cast("string")).alias("competitor_id"), "url", (n + 200).alias("status"), F.col("html").alias("body"),
        F.timestamp_seconds((pid * 7 + n * 13) % 29).alias("landed_at"))
    latest = latest_responses(rows, ["competitor_id", "url"])
    return latest.select("competitor_id", "url", F.col("status").cast("bigint").alias("status"))
