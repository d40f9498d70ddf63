"""URL, domain, text and time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.functions import text as X
from sitetide.functions import times as T
from sitetide.functions import urls as U
from sitetide.functions.jsons import json_or_raw, json_string_array, to_json_col
from sitetide.queries import inputs as I
from sitetide.queries.registry import query


# Labels that the newer rules for international hosts keep or refuse, and their ASCII form.
LABELS = [("stra\u00dfe", "xn--strae-oqa"), ("\u03b2\u03cc\u03bb\u03bf\u03c2", "xn--nxasmm1c"), ("M\u00dcNCHEN", "xn--mnchen-3ya"),
          ("\u0dc1\u0dca\u200d\u0dbb\u0dd3", "xn--10cl1a0b660p"), ("\u0646\u0627\u0645\u0647\u200c\u0627\u06cc", "xn--mgba3gch31f060k"), ("a\u200cb", None)]


@query("normalize_url", f"""WITH {I.VARIANTS_SQL}
SELECT page_id, variant, {I.norm_sql('url')} AS normalized_url FROM v
{" ".join(f"UNION ALL SELECT page_id, {i}, " + ("NULL" if to is None else f"replace({I.norm_sql('url')}, '://', '://{to}.')") + " FROM pages" for i, (_, to) in enumerate(LABELS, 5))}""")
def normalize_url(spark, sf):
    """Every page URL in five spellings, and below six international labels."""
    pages = I.read(spark, sf, "pages")
    below = F.array(*[F.replace("url", F.lit("://"), F.lit(f"://{label}.")) for label, _ in LABELS])
    international = pages.select("page_id", F.posexplode(below).alias("at", "url")).select("page_id", (F.col("at") + 5).cast("bigint").alias("variant"), "url")
    rows = I.url_variants(spark, sf).select("page_id", "variant", "url").unionByName(international)
    return rows.select("page_id", "variant", U.normalize_url("url").alias("normalized_url"))


@query("normalize_domain", f"""
WITH {I.VARIANTS_SQL}
SELECT page_id, variant, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)), '^www[.]', '') AS domain FROM v""")
def normalize_domain(spark, sf):
    return I.url_variants(spark, sf).select("page_id", "variant", U.normalize_domain("url").alias("domain"))


@query("same_host", f"""
SELECT page_id, page_id % 3 <> 2 AS same FROM pages""")
def same_host(spark, sf):
    parent = F.regexp_replace(I.host(), r"^(www\.|m\.|blog\.)", "")
    domain = F.when(F.col("page_id") % 3 == 0, I.host()).when(F.col("page_id") % 3 == 1, F.upper(parent)).otherwise(
        F.concat(F.lit("x"), parent))
    return I.read(spark, sf, "pages").select("page_id", U.same_host("url", domain).alias("same"))


GUARD_URLS = [
    ("u", None),
    ("'https://user:pw@' || substr(u, instr(u, '://') + 3)", U.REASON_CREDENTIALS),
    ("'http://localhost/' || CAST(page_id AS VARCHAR)", U.REASON_LOCALHOST),
    ("'http://10.0.0.' || CAST(page_id % 256 AS VARCHAR) || '/'", U.REASON_PRIVATE_IP),
    ("'ftp://' || h || '/x'", U.REASON_SCHEME),
    ("'no url ' || CAST(page_id AS VARCHAR)", U.REASON_INVALID),
]


@query("outbound_guard", f"""
WITH p AS (SELECT page_id, url AS u, {I.HOST_SQL} AS h FROM pages)
{" UNION ALL ".join(
    f"SELECT page_id, {i}::BIGINT AS kind, {'TRUE' if reason is None else 'FALSE'} AS ok, "
    f"{'NULL' if reason is None else chr(39) + reason + chr(39)}::VARCHAR AS reason FROM p"
    for i, (_, reason) in enumerate(GUARD_URLS))}
UNION ALL SELECT page_id, 6, FALSE, 'Outbound host attacker.example is outside competitor domain ' || h FROM p""")
def outbound_guard(spark, sf):
    pages = I.read(spark, sf, "pages").select("page_id", F.col("url").alias("u"), I.host().alias("h"))
    targets = [F.expr(sql.replace("VARCHAR", "STRING")) for sql, _ in GUARD_URLS]
    targets.append(F.lit("https://attacker.example/steal"))
    rows = pages.select("page_id", "h", F.posexplode(F.array(*targets)).alias("kind", "target"))
    return rows.withColumn("g", U.outbound_guard("target", "h")).select(
        "page_id", F.col("kind").cast("bigint").alias("kind"), F.col("g.ok").alias("ok"), F.col("g.reason").alias("reason"))


@query("strip_tracking", f"""
WITH {I.VARIANTS_SQL}
SELECT page_id, variant,
  len(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''))::BIGINT AS params,
  array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'),
    lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)')), '&') AS kept
FROM v""")
def strip_tracking(spark, sf):
    params = U.query_params(F.regexp_extract("url", r"\?([^#]*)", 1))
    return I.url_variants(spark, sf).withColumn("params", params).select(
        "page_id", "variant", F.size("params").cast("bigint").alias("params"),
        U.encode_params(U.strip_tracking("params")).alias("kept"))


@query("sort_params", f"""
WITH {I.VARIANTS_SQL}
SELECT page_id, variant, array_to_string(list_transform(list_sort(list_transform(list_filter(
  string_split('c=3&b=' || CAST(variant AS VARCHAR) || '&' || regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> ''),
  lambda x: lower(x) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)), '&') AS query
FROM v""")
def sort_params(spark, sf):
    text = F.concat(F.lit("c=3&b="), F.col("variant").cast("string"), F.lit("&"), F.regexp_extract("url", r"\?([^#]*)", 1))
    return I.url_variants(spark, sf).withColumn("params", U.query_params(text)).select(
        "page_id", "variant", U.encode_params(U.sort_params("params")).alias("query"))


@query("blocked_ip", """
WITH ip AS (
  SELECT event_id, event_id % 259 AS a, (event_id * 7) % 256 AS b, user_id % 256 AS c, CAST(value AS BIGINT) % 256 AS d FROM events)
SELECT event_id, a > 255 OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 168) OR a >= 224 AS blocked FROM ip""")
def blocked_ip(spark, sf):
    events = I.read(spark, sf, "events")
    octets = [F.col("event_id") % 259, (F.col("event_id") * 7) % 256, F.col("user_id") % 256, F.rint("value").cast("bigint") % 256]
    ip = F.concat_ws(".", *[o.cast("string") for o in octets])
    return events.select("event_id", U.is_blocked_ip(ip).alias("blocked"))


@query("safe_normalize", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page ' || url ELSE {I.norm_sql('url')} END AS safe_url FROM pages""")
def safe_normalize(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), F.col("url"))).otherwise(F.col("url"))
    return I.read(spark, sf, "pages").select("page_id", raw.alias("raw")).select(
        "page_id", U.safe_normalize("raw").alias("safe_url"))


REFS = ["/new.xml", "next.html", "//cdn.example.org/x", "https://other.example.org/Y?b=1", "?p=2", "../up", "./same/./x"]


@query("resolve_url", f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)', 1) AS s, {I.HOST_SQL} AS h,
  regexp_replace(url, '[?#].*$', '') AS bare FROM pages),
b AS (SELECT *, s || '://' || h AS origin, regexp_replace(bare, '[^/]*$', '') AS dir FROM p)
SELECT page_id, CASE page_id % 7
  WHEN 0 THEN origin || '/new.xml' WHEN 1 THEN dir || 'next.html' WHEN 2 THEN s || '://cdn.example.org/x'
  WHEN 3 THEN 'https://other.example.org/Y?b=1' WHEN 4 THEN bare || '?p=2'
  WHEN 5 THEN CASE WHEN dir = origin || '/' THEN dir ELSE regexp_replace(dir, '[^/]+/$', '') END || 'up'
  ELSE dir || 'same/x' END AS resolved
FROM b""")
def resolve_url(spark, sf):
    ref = F.element_at(F.array(*map(F.lit, REFS)), (F.col("page_id") % 7 + 1).cast("int"))
    return I.read(spark, sf, "pages").select("page_id", "url", ref.alias("ref")).select(
        "page_id", U.resolve_url("ref", "url").alias("resolved"))


@query("url_dedupe", f"""
WITH {I.VARIANTS_SQL}, n AS (SELECT page_id, variant, url, {I.norm_sql('url')} AS normalized_url FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY page_id, variant) AS rn,
  count(*) OVER (PARTITION BY normalized_url) AS copies FROM n)
SELECT normalized_url, url, copies FROM r WHERE rn = 1""")
def url_dedupe(spark, sf):
    rows = I.url_variants(spark, sf).select("page_id", "variant", "url", U.normalize_url("url").alias("normalized_url"))
    return rows.groupBy("normalized_url").agg(
        F.min_by("url", F.struct("page_id", "variant")).alias("url"), F.count(F.lit(1)).alias("copies"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return I.read(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("content_hash"))


@query("entity_ids", f"""
SELECT page_id, 'page_' || substr(sha256({I.HOST_SQL} || chr(31) || url), 1, 32) AS id FROM pages""")
def entity_ids(spark, sf):
    return I.read(spark, sf, "pages").select("page_id", X.make_id("page", I.host(), "url").alias("id"))


@query("business_days", f"""
SELECT {I.stamp_sql("date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR")} AS day_start,
  count(*) AS events, count(DISTINCT date_trunc('day', ts)) AS utc_days FROM events GROUP BY 1""")
def business_days(spark, sf):
    events = I.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return events.groupBy(I.stamp(T.shanghai_day_start("ts")).alias("day_start")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(T.utc_day_start("ts")).alias("utc_days"))


@query("excerpt_clips", """
SELECT doc_id, length(substr(text, 1, 8000)) AS excerpt_chars, md5(substr(text, 1, 8000)) AS excerpt_md5,
  md5(substr(text, 1, 4000)) AS raw_md5, md5(substr(text, 1, 2000)) AS error_md5 FROM documents""")
def excerpt_clips(spark, sf):
    clipped = X.clip("text", X.EXCERPT_CHARS)
    return I.read(spark, sf, "documents").select(
        "doc_id", F.length(clipped).cast("bigint").alias("excerpt_chars"), F.md5(clipped).alias("excerpt_md5"),
        F.md5(X.clip("text", X.RAW_RESPONSE_CHARS)).alias("raw_md5"),
        F.md5(X.clip("text", X.ANALYSIS_ERROR_CHARS)).alias("error_md5"))


@query("empty_to_null", f"""
SELECT doc_id, line_no, nullif(regexp_replace(regexp_replace(line, '^{I.SPACES}+', ''), '{I.SPACES}+$', ''), '') AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents)""")
def empty_to_null(spark, sf):
    lines = I.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.empty_to_null("line").alias("line"))


@query("csv_cells", f"""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '@"' ELSE '' END || text AS v FROM documents)
SELECT doc_id, md5('"' || replace(CASE WHEN regexp_matches(v, '^{I.SPACES}*[=+@-]') THEN '''' || v ELSE v END, '"', '""') || '"') AS cell FROM t""")
def csv_cells(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ["=", "  +", '@"', ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    return I.read(spark, sf, "documents").select(
        "doc_id", F.md5(X.csv_cell(F.concat(lead, F.col("text")))).alias("cell"))


@query("json_columns", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '[]' ELSE '["' || event_type || '","k"]' END AS strings,
  CASE WHEN event_id % 3 = 0 THEN '"' || event_type || '"' ELSE replace(props, ' ', '') END AS value
FROM events""")
def json_columns(spark, sf):
    events = I.read(spark, sf, "events")
    kind = F.col("event_id") % 3
    listed = F.when(kind == 2, F.lit("[oops")).otherwise(
        F.concat(F.lit('["'), F.col("event_type"), F.lit('", 1, null, {"a":1}, "k"]')))
    raw = F.when(kind == 0, F.col("event_type")).otherwise(F.col("props"))
    return events.select("event_id", listed.alias("listed"), raw.alias("raw")).select(
        "event_id", to_json_col(json_string_array("listed")).alias("strings"), json_or_raw("raw").alias("value"))
