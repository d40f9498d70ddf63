"""Sitemap, robots and traversal queries over documents derived from the driver pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.operators import sitemap_sources as SS
from sitetide.operators.scans import error_summary
from sitetide.operators.traversal import Limits, expand_sitemaps, scan_complete, sitemap_url_counts
from sitetide.operators.windows import first_entry
from sitetide.queries import inputs as I
from sitetide.queries.registry import query
from sitetide.schemas import conform, empty_table
from sitetide.sources import sitemaps as S


#: Page ids of one URL set, and of one index below a site's index: documents stay small, sites are as large as their hosts.
SET_IDS, INDEX_IDS = 50, 1000


def _pages(spark, sf):
    """Driver pages with a site per host, and the URL set and index that list them."""
    return I.read(spark, sf, "pages").select(
        "page_id", "url", I.host().alias("host"), F.expr(f"page_id DIV {SET_IDS}").alias("b"), F.expr(f"page_id DIV {INDEX_IDS}").alias("g"))


def sitemap_docs(spark, sf):
    """Per site: an index of indexes, each of these lists three URL sets (pages split by id) for every SET_IDS page ids; the
    last child of the first index answers 503 or is empty.

    The URLs of split 2 are listed again in split 0, so documents overlap; a set without pages has not landed.
    """
    pages = _pages(spark, sf)
    split = (F.col("page_id") % 3).cast("int")
    part = F.explode(F.when(split == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array(split)))
    node = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>2024-01-"),
                    F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    ordered = F.array_sort(F.collect_list(F.struct("page_id", node.alias("node"))))
    base = F.concat(F.lit("https://"), "host")
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    sets = pages.withColumn("part", part).groupBy("host", "b", "part").agg(ordered.alias("nodes")).select(
        "host", F.concat(base, F.lit("/s"), F.col("b").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit(".xml")).alias("url"),
        F.concat(F.lit(head), F.array_join(F.transform("nodes", lambda n: n["node"]), ""), F.lit("</urlset>")).alias("body"),
        F.lit(200).alias("status"))

    def index(names):
        children = F.transform(names, lambda name: F.concat(F.lit("<sitemap><loc>"), base, F.lit("/"), name, F.lit(".xml</loc></sitemap>")))
        return F.concat(F.lit("<sitemapindex>"), F.array_join(children, ""), F.lit("</sitemapindex>")).alias("body")

    three = F.flatten(F.transform(F.array_sort(F.collect_set("b")), lambda b: F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)), lambda n: F.concat(F.lit("s"), b.cast("string"), F.lit("-"), n.cast("string")))))
    below = pages.groupBy("host", "g").agg(three.alias("names")).select(
        "host", F.concat(base, F.lit("/g"), F.col("g").cast("string"), F.lit(".xml")).alias("url"), index(F.col("names")), F.lit(200).alias("status"))
    groups = F.transform(F.array_sort(F.collect_set("g")), lambda g: F.concat(F.lit("g"), g.cast("string")))
    roots = pages.groupBy("host").agg(F.array_append(groups, F.lit("s9")).alias("names")).select(
        "host", F.concat(base, F.lit("/sitemap.xml")).alias("url"), index(F.col("names")), F.lit(200).alias("status"))
    down = F.length("host") % 2 == 0
    last = pages.select("host").distinct().select(
        "host", F.concat(base, F.lit("/s9.xml")).alias("url"), F.when(down, F.lit("down")).otherwise(F.lit('<urlset xmlns="x"/>')).alias("body"),
        F.when(down, F.lit(503)).otherwise(F.lit(200)).alias("status"))
    docs = sets.unionByName(below).unionByName(roots).unionByName(last)
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("host").alias("competitor_id"), F.col("host").alias("domain"), "url", "status", none.alias("content_length"),
        "body", none.alias("error"), none.alias("error_source"))


def seeds(spark, sf):
    return _pages(spark, sf).select("host").distinct().select(
        F.col("host").alias("competitor_id"), F.col("host").alias("domain"), F.concat(F.lit("src_"), "host").alias("source_id"),
        F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), F.lit(0).alias("seed_order"))


# docs has a row for every document that an index lists, and for the first index; (o1, o2, o3) is the order of the walk.
PARTS_SQL = f"""
  parts AS (
    SELECT {I.HOST_SQL} AS host, page_id, url, page_id // {SET_IDS} AS b, page_id // {INDEX_IDS} AS g, page_id % 3 AS part FROM pages
    UNION ALL SELECT {I.HOST_SQL}, page_id, url, page_id // {SET_IDS}, page_id // {INDEX_IDS}, 0 FROM pages WHERE page_id % 3 = 2),
  hosts AS (SELECT DISTINCT host FROM parts),
  docs AS (
    SELECT host, 'https://' || host || '/sitemap.xml' AS url, NULL AS parent, 0 AS position, 0 AS depth, -1 AS o1, -1 AS o2, -1 AS o3 FROM hosts
    UNION ALL SELECT host, 'https://' || host || '/g' || g || '.xml', 'https://' || host || '/sitemap.xml', row_number() OVER (PARTITION BY host ORDER BY g) - 1, 1, g, -1, -1
      FROM (SELECT DISTINCT host, g FROM parts)
    UNION ALL SELECT host, 'https://' || host || '/s9.xml', 'https://' || host || '/sitemap.xml', count(DISTINCT g), 1, max(g) + 1, -1, -1 FROM parts GROUP BY host
    UNION ALL SELECT host, 'https://' || host || '/s' || b || '-' || n || '.xml', 'https://' || host || '/g' || g || '.xml',
      (row_number() OVER (PARTITION BY host, g, n ORDER BY b) - 1) * 3 + n, 2, g, b, n FROM (SELECT DISTINCT host, g, b FROM parts), range(3) r(n))"""


@query("sitemap_parse", f"""WITH {PARTS_SQL}
SELECT host AS competitor_id, 'https://' || host || '/s' || b || '-' || part || '.xml' AS document, url AS loc, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod FROM parts""")
def sitemap_parse(spark, sf):
    docs = sitemap_docs(spark, sf).select("competitor_id", F.col("url").alias("document"), "body")
    return S.parse_sitemaps(docs, ["competitor_id", "document"]).entries.drop("position")


@query("sitemap_children", f"""WITH {PARTS_SQL}
SELECT host AS competitor_id, parent AS document, position::BIGINT AS position, url AS loc FROM docs WHERE parent IS NOT NULL""")
def sitemap_children(spark, sf):
    docs = sitemap_docs(spark, sf).select("competitor_id", F.col("url").alias("document"), "body")
    children = S.parse_sitemaps(docs, ["competitor_id", "document"]).children
    return children.select("competitor_id", "document", F.col("position").cast("bigint").alias("position"), "loc")


@query("sitemap_status", f"""WITH {PARTS_SQL}
SELECT 'https://' || host || '/s' || b || '-' || part || '.xml' AS document, 'urlset' AS doc_type, count(*) AS node_count, NULL AS parse_error FROM parts GROUP BY host, b, part
UNION ALL SELECT parent, 'sitemapindex', count(*), NULL FROM docs WHERE parent IS NOT NULL GROUP BY parent
UNION ALL SELECT 'https://' || host || '/s9.xml', CASE WHEN length(host) % 2 = 1 THEN 'urlset' END, 0,
  CASE WHEN length(host) % 2 = 0 THEN '{S.UNSUPPORTED_XML}' END FROM hosts""")
def sitemap_status(spark, sf):
    docs = sitemap_docs(spark, sf).select(F.col("url").alias("document"), "body")
    return S.parse_sitemaps(docs, ["document"]).doc_status.withColumn("node_count", F.col("node_count").cast("bigint"))


FIRST_SQL = f"""{PARTS_SQL},
  first AS (
    SELECT host, {I.norm_sql('url')} AS normalized_url, b, part, url FROM parts
    QUALIFY row_number() OVER (PARTITION BY host, normalized_url ORDER BY b, part, page_id) = 1)"""


@query("sitemap_expand", f"""WITH {FIRST_SQL}
SELECT host AS competitor_id, normalized_url, url, 'https://' || host || '/s' || b || '-' || part || '.xml' AS source_url FROM first""")
def sitemap_expand(spark, sf):
    out = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf))
    return out.entries.select("competitor_id", "normalized_url", "url", "source_url")


VISITS_SQL = f"""WITH {FIRST_SQL},
counted AS (SELECT host, b, part, count(*) AS n FROM first GROUP BY ALL),
landed AS (SELECT DISTINCT host, b, part FROM parts),
v AS (
  SELECT d.host, d.url, d.depth, d.o1, d.o2, d.o3, coalesce(c.n, 0) AS url_count,
    CASE WHEN ends_with(d.url, '/s9.xml') AND length(d.host) % 2 = 0 THEN 'SITEMAP_HTTP_ERROR' WHEN d.depth = 2 AND l.part IS NULL THEN 'SITEMAP_FETCH_FAILED' END AS error_code,
    CASE WHEN ends_with(d.url, '/s9.xml') AND length(d.host) % 2 = 0 THEN 'HTTP 503' WHEN d.depth = 2 AND l.part IS NULL THEN 'No landed response' END AS error_message
  FROM docs d LEFT JOIN landed l ON l.host = d.host AND l.b = d.o2 AND l.part = d.o3 LEFT JOIN counted c ON c.host = d.host AND c.b = d.o2 AND c.part = d.o3)
"""


@query("sitemap_visits", f"""{VISITS_SQL}
SELECT host AS competitor_id, url, depth::BIGINT AS depth, CASE WHEN error_code IS NULL THEN 'success' ELSE 'failed' END AS status, error_code, error_message, url_count::BIGINT AS url_count FROM v""")
def sitemap_visits(spark, sf):
    visits = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf)).visits
    return visits.select(
        "competitor_id", "url", F.col("depth").cast("bigint").alias("depth"), "status", "error_code", "error_message", "url_count")


@query("scan_complete", f"""{VISITS_SQL}
SELECT host AS competitor_id, bool_and(error_code IS NULL) AS is_complete,
  string_agg(url || ': ' || error_message, chr(10) ORDER BY o1, o2, o3) FILTER (error_code IS NOT NULL) AS error_summary FROM v GROUP BY 1""")
def scan_completeness(spark, sf):
    visits = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf)).visits
    return scan_complete(visits, ["competitor_id"]).join(
        error_summary(visits, ["competitor_id"]), "competitor_id", "left")


@query("sitemap_limits", f"""{VISITS_SQL}
SELECT host AS competitor_id, url, CASE WHEN n > 3 THEN 'SITEMAP_COUNT_LIMIT' ELSE error_code END AS error_code FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY o1, o2, o3) AS n, min(o1) FILTER (depth = 2) OVER (PARTITION BY host) AS opened FROM v)
WHERE depth < 2 OR o1 = opened""")
def sitemap_limits(spark, sf):
    visits = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf), Limits(max_sitemaps=3)).visits
    return visits.select("competitor_id", "url", "error_code")


@query("sitemap_depth_limit", f"""{VISITS_SQL}
SELECT host AS competitor_id, url, CASE WHEN depth = 2 THEN 'SITEMAP_DEPTH_LIMIT' ELSE error_code END AS error_code FROM v""")
def sitemap_depth_limit(spark, sf):
    visits = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf), Limits(max_depth=1)).visits
    return visits.select("competitor_id", "url", "error_code")


@query("url_limit", f"""WITH {FIRST_SQL}, ranked AS (
  SELECT host, row_number() OVER (PARTITION BY host ORDER BY b, part) AS rn FROM first)
SELECT host AS competitor_id, count(*) AS urls FROM ranked WHERE rn <= 2 GROUP BY 1""")
def url_limit(spark, sf):
    entries = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf), Limits(max_urls=2)).entries
    return entries.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("urls"))


@query("discovered_children", f"""WITH {PARTS_SQL}
SELECT host AS competitor_id, url, parent AS parent_url FROM docs WHERE parent IS NOT NULL""")
def discovered_children(spark, sf):
    children = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf)).children
    return children.select("competitor_id", "url", "parent_url")


@query("first_wins", f"""WITH {PARTS_SQL} SELECT host AS competitor_id, url, min(b * 3 + part)::BIGINT AS path FROM parts GROUP BY 1, 2""")
def first_wins(spark, sf):
    docs = sitemap_docs(spark, sf).select("competitor_id", F.col("url").alias("document"), "body")
    number = lambda i: F.regexp_extract("document", "/s([0-9]+)-([0-9])[.]xml", i).cast("bigint")
    entries = S.parse_sitemaps(docs, ["competitor_id", "document"]).entries.select(
        "competitor_id", F.col("loc").alias("url"), F.col("loc").alias("normalized_url"), "position", (number(1) * 3 + number(2)).alias("path"))
    return first_entry(entries).select("competitor_id", "url", "path")


@query("sitemap_url_counts", f"""WITH {PARTS_SQL}, counted AS (SELECT host, part, count(*) AS n FROM parts GROUP BY 1, 2)
SELECT h.host AS competitor_id, 's' || p.n AS path, coalesce(c.n, 0) AS url_count FROM hosts h CROSS JOIN range(4) p(n)
LEFT JOIN counted c ON c.host = h.host AND c.part = p.n""")
def url_counts(spark, sf):
    split = F.col("page_id") % 3
    entries = _pages(spark, sf).select(
        F.col("host").alias("competitor_id"),
        F.explode(F.when(split == 2, F.array(F.lit("s0"), F.lit("s2"))).otherwise(F.array(F.concat(F.lit("s"), split.cast("string"))))).alias("path"))
    visits = entries.select("competitor_id").distinct().select(
        "competitor_id", F.explode(F.array(*[F.lit(f"s{i}") for i in range(4)])).alias("path"), F.lit("u").alias("url"))
    return sitemap_url_counts(entries, visits).select("competitor_id", "path", "url_count")


def robots_files(spark, sf):
    """robots.txt per host with a usable, an off-domain, a malformed and a repeated declaration."""
    hosts = I.read(spark, sf, "pages").groupBy(I.host().alias("host")).agg(F.min("page_id").alias("n"))
    base = F.concat(F.lit("https://"), "host")
    body = F.concat(
        F.lit("User-agent: *\r\nDisallow: /x\n  sitemap :  "), base, F.lit("/a-"), F.col("n").cast("string"),
        F.lit(".xml?utm_source=r  \nSitemap: https://evil.example/x.xml\nSitemap: nope\nSITEMAP:"), base, F.lit("/sitemap.xml\r\nSitemap: "),
        base, F.lit("/a-"), F.col("n").cast("string"), F.lit(".xml\nSitemap: two words\n"))
    none = F.lit(None).cast("string")
    return hosts.select(
        F.col("host").alias("competitor_id"), F.col("host").alias("domain"), F.when(F.col("n") % 5 == 4, 404).otherwise(200).alias("status"),
        body.alias("body"), none.alias("content_length"), none.alias("error"))


ROBOTS_SQL = f"""robots AS (SELECT {I.HOST_SQL} AS host, min(page_id) AS n FROM pages GROUP BY 1)"""


@query("robots_parse", f"""WITH {ROBOTS_SQL}, ok AS (SELECT * FROM robots WHERE n % 5 <> 4)
SELECT host AS competitor_id, 'https://' || host || '/a-' || n || '.xml?utm_source=r' AS url, 'https://' || host || '/a-' || n || '.xml' AS normalized_url FROM ok
UNION ALL SELECT host, 'https://' || host || '/sitemap.xml', 'https://' || host || '/sitemap.xml' FROM ok
UNION ALL SELECT host, 'https://' || host || '/a-' || n || '.xml', 'https://' || host || '/a-' || n || '.xml' FROM ok""")
def robots_parse(spark, sf):
    return S.parse_robots(robots_files(spark, sf)).select("competitor_id", "url", "normalized_url")


def common_hits(spark, sf):
    """Landed responses at the common paths: sitemap.xml for all, the others for some, one too long."""
    hosts = I.read(spark, sf, "pages").groupBy(I.host().alias("host")).agg(F.min("page_id").alias("n"))
    n = F.col("n")
    body = (
        F.when(F.col("path") == "/sitemap.xml", F.lit("<?xml version='1.0'?><URLSET>"))
        .when(F.col("path") == "/sitemap_index.xml", F.when(n % 2 == 0, F.lit("<html>")).otherwise(F.lit("<sitemapindex>")))
        .otherwise(F.when(n % 3 == 0, F.rpad(F.lit("<urlset>"), 4097, " ")).otherwise(F.lit("<urlset>")))
    )
    none = F.lit(None).cast("string")
    rows = hosts.select("host", "n", F.explode(F.array(*[F.lit(p) for p in S.COMMON_PATHS])).alias("path"))
    domains = hosts.select(F.col("host").alias("competitor_id"), F.col("host").alias("domain"))
    landed = rows.select(
        F.col("host").alias("competitor_id"), F.concat(F.lit("https://"), "host", "path").alias("url"), F.lit(200).alias("status"),
        none.alias("content_length"), body.alias("body"), none.alias("error"))
    return S.probe_common_paths(domains, landed, S.PREVIEW_MAX_BYTES)


COMMON_SQL = """common AS (
  SELECT host, '/sitemap.xml' AS path FROM robots UNION ALL SELECT host, '/sitemap_index.xml' FROM robots WHERE n % 2 <> 0
  UNION ALL SELECT host, '/wp-sitemap.xml' FROM robots WHERE n % 3 <> 0)"""


@query("common_paths", f"WITH {ROBOTS_SQL}, {COMMON_SQL} SELECT host AS competitor_id, 'https://' || host || path AS url FROM common")
def common_paths(spark, sf):
    return common_hits(spark, sf).select("competitor_id", "url")


ROOTS_SQL = f"""WITH {ROBOTS_SQL}, {COMMON_SQL}, ok AS (SELECT * FROM robots WHERE n % 5 <> 4),
roots AS (
  SELECT host, 'https://' || host || '/a-' || n || '.xml' AS url, 'robots' AS source_type FROM ok
  UNION ALL SELECT host, 'https://' || host || '/sitemap.xml', 'robots' FROM ok
  UNION ALL SELECT host, 'https://' || host || path, 'common_path' FROM common WHERE path <> '/sitemap.xml' OR host NOT IN (SELECT host FROM ok))"""


@query("root_candidates", f"{ROOTS_SQL} SELECT host AS competitor_id, url AS normalized_url, url, source_type FROM roots")
def root_candidates(spark, sf):
    return S.root_candidates(S.parse_robots(robots_files(spark, sf)), common_hits(spark, sf)).drop("root_order")


def _known_sources(spark, sf):
    """Sites with an even first page id already have their sitemap.xml as a source, enabled for every other one."""
    hosts = _pages(spark, sf).groupBy("host").agg(F.min("page_id").alias("n")).filter(F.col("n") % 2 == 0)
    url = F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))
    t = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return conform(hosts.select(
        F.concat(F.lit("old_"), "host").alias("id"), F.col("host").alias("competitor_id"), url.alias("url"), url.alias("normalized_url"),
        F.lit("manual").alias("source_type"), (F.col("n") % 4 == 0).alias("is_enabled"), F.lit(False).alias("is_discovered"),
        t.alias("created_at"), t.alias("updated_at")), "sitemap_sources")


@query("insert_or_ignore", f"""{ROOTS_SQL}
SELECT host AS competitor_id, url AS normalized_url, source_type, TRUE AS is_enabled FROM roots r
WHERE NOT EXISTS (SELECT 1 FROM robots k WHERE k.host = r.host AND k.n % 2 = 0 AND r.url = 'https://' || k.host || '/sitemap.xml')
UNION ALL SELECT host, 'https://' || host || '/sitemap.xml', 'manual', n % 4 = 0 FROM robots WHERE n % 2 = 0""")
def insert_or_ignore(spark, sf):
    roots = S.root_candidates(S.parse_robots(robots_files(spark, sf)), common_hits(spark, sf))
    after = SS.add_root_sources(_known_sources(spark, sf), roots, F.lit(I.AS_OF).cast("timestamp"))
    return after.select("competitor_id", "normalized_url", "source_type", "is_enabled")


@query("child_sources", f"""WITH {PARTS_SQL}, n AS (SELECT host, min(page_id) AS n FROM parts GROUP BY 1)
SELECT d.host AS competitor_id, d.url AS normalized_url, 'sitemap_index_child' AS source_type,
  CASE WHEN d.depth = 2 THEN 'smp_' || substr(sha256(d.host || chr(31) || d.parent), 1, 32) WHEN n.n % 4 = 0 THEN 'old_' || d.host END AS parent_source_id
FROM docs d JOIN n USING (host) WHERE d.parent IS NOT NULL
UNION ALL SELECT host, 'https://' || host || '/sitemap.xml', 'manual', NULL FROM n WHERE n % 2 = 0""")
def child_sources(spark, sf):
    children = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf)).children
    after = SS.add_child_sources(_known_sources(spark, sf), children, F.lit(I.AS_OF).cast("timestamp"))
    return after.select("competitor_id", "normalized_url", "source_type", "parent_source_id")


@query("record_processed", f"""{VISITS_SQL}
SELECT 'scan_' || host AS scan_run_id, url AS requested_url, CASE WHEN error_code IS NULL THEN 'success' ELSE 'failed' END AS result_status, url_count::BIGINT AS url_count,
  CASE WHEN depth = 0 THEN 'src_' || host END AS sitemap_source_id FROM v""")
def record_processed(spark, sf):
    visits = expand_sitemaps(seeds(spark, sf), sitemap_docs(spark, sf)).visits
    runs = visits.select("competitor_id").distinct().select("competitor_id", F.concat(F.lit("scan_"), "competitor_id").alias("scan_run_id"))
    rows = SS.record_processed(
        visits, empty_table(spark, "sitemap_sources"), runs, F.lit(I.AS_OF).cast("timestamp"))
    return rows.select("scan_run_id", "requested_url", "result_status", "url_count", "sitemap_source_id")


@query("seed_order", f"""
SELECT CAST(page_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY {I.HOST_SQL}
  ORDER BY CASE page_id % 3 WHEN 0 THEN 'common_path' WHEN 1 THEN 'manual' ELSE 'robots' END, page_id % 50, CAST(page_id AS VARCHAR)) - 1 AS seed_order
FROM pages WHERE page_id % 4 <> 0""")
def seed_order(spark, sf):
    pid = F.col("page_id")
    kind = F.element_at(F.array(F.lit("common_path"), F.lit("manual"), F.lit("robots")), (pid % 3 + 1).cast("int"))
    sources = I.read(spark, sf, "pages").select(
        pid.cast("string").alias("id"), I.host().alias("competitor_id"), kind.alias("source_type"),
        (pid % 4 != 0).alias("is_enabled"), F.timestamp_seconds(pid % 50).alias("created_at"))
    return SS.seed_order(sources).select("id", F.col("seed_order").cast("bigint").alias("seed_order"))
