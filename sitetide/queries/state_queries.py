"""Competitor, scan-run, review and quality queries over orders, customers and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.operators import competitors as C
from sitetide.operators import quality as Q
from sitetide.operators import reviews as R
from sitetide.operators import scans as S
from sitetide.operators.fetches import fetch_targets
from sitetide.operators.lifecycle import append_events, without_event
from sitetide.operators.sitemap_sources import manual_urls
from sitetide.operators.sitemap_sources import sources_of_scan as sources_for
from sitetide.operators.windows import placed
from sitetide.queries import inputs as I
from sitetide.queries.registry import query
from sitetide.schemas import conform, empty_table

SCAN_NOW = "1998-06-01T00:00:00Z"
SCAN_NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


def now():
    return F.lit(SCAN_NOW).cast("timestamp")


def customers(spark, sf):
    """Customers as competitors: two in nine are deleted, names repeat as domains."""
    key = F.col("c_custkey")
    t = F.lit("1998-01-01T00:00:00Z").cast("timestamp")
    return conform(I.read(spark, sf, "customer").select(
        key.cast("string").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("c"), key.cast("string"), F.lit(".example.com")).alias("domain"), (key % 4 != 0).alias("is_enabled"),
        (key % 3 == 0).alias("baseline_established"), t.alias("created_at"), t.alias("updated_at"),
        F.when(key % 9 < 2, t).alias("deleted_at")), "competitors")


def scan_runs(spark, sf):
    """Orders as scan runs: status F is running, O success, P partial."""
    key = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("running")).when(
        F.col("o_orderstatus") == "O", F.lit("success")).otherwise(F.lit("partial_success"))
    zero = F.lit(0).cast("bigint")
    return conform(I.read(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("competitor_id"), F.lit("cron").alias("trigger_type"),
        status.alias("status"), (status == "success").alias("is_complete"), zero.alias("sitemap_count"),
        (key % 1000).alias("total_url_count"), (key % 7).alias("new_count"), (key % 5).alias("missing_count"),
        zero.alias("reappeared_count"), zero.alias("fetch_success_count"), zero.alias("fetch_failed_count"),
        zero.alias("analysis_success_count"), zero.alias("analysis_failed_count"),
        F.when(key % 10 == 0, F.lit("kept")).alias("error_summary"), at.alias("started_at"), at.alias("created_at")), "scan_runs")


RUNS_SQL = """
  runs AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS competitor_id, o_custkey AS ck, o_orderdate AS began,
      CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'success' ELSE 'partial_success' END AS status,
      CASE WHEN o_orderkey % 10 = 0 THEN 'kept' END AS error_summary
    FROM orders),
  cust AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_name AS name, c_custkey % 9 < 2 AS is_deleted FROM customer)"""


@query("stale_runs", f"""WITH {RUNS_SQL}
SELECT id, CASE WHEN status = 'running' AND began < {SCAN_NOW_SQL} - INTERVAL 6 HOUR THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' AND began < {SCAN_NOW_SQL} - INTERVAL 6 HOUR THEN coalesce(error_summary, 'Recovered stale running scan') ELSE error_summary END AS error_summary,
  CASE WHEN status = 'running' AND began < {SCAN_NOW_SQL} - INTERVAL 6 HOUR THEN '1998-06-01 00:00:00' END AS finished_at FROM runs""")
def stale_runs(spark, sf):
    return S.fail_stale(scan_runs(spark, sf), None, now()).select(
        "id", "status", "error_summary", I.stamp("finished_at").alias("finished_at"))


OPEN_SQL = f"""WITH {RUNS_SQL}, swept AS (
  SELECT *, CASE WHEN status = 'running' AND began < {SCAN_NOW_SQL} - INTERVAL 6 HOUR AND ck % 2 = 0 THEN 'failed' ELSE status END AS after FROM runs),
busy AS (SELECT competitor_id, min(id) AS running_id FROM swept WHERE after = 'running' GROUP BY 1),
asked AS (SELECT id AS competitor_id FROM cust WHERE k % 2 = 0)"""


@query("open_scans", f"""{OPEN_SQL}
SELECT 'opened' AS outcome, 'scan_' || substr(sha256(a.competitor_id || chr(31) || '1998-06-01 00:00:00'), 1, 32) AS scan_run_id, a.competitor_id
FROM asked a WHERE a.competitor_id NOT IN (SELECT competitor_id FROM busy)
UNION ALL SELECT 'SCAN_ALREADY_RUNNING', b.running_id, a.competitor_id FROM asked a JOIN busy b USING (competitor_id)""")
def open_scans(spark, sf):
    requests = customers(spark, sf).filter(F.col("id").cast("bigint") % 2 == 0).select(
        F.col("id").alias("competitor_id"), F.lit("cron").alias("trigger_type"))
    _, opened, rejects = S.open_scans(scan_runs(spark, sf), requests, now())
    good = opened.select(F.lit("opened").alias("outcome"), F.col("id").alias("scan_run_id"), "competitor_id")
    return good.unionByName(rejects.select(F.col("code").alias("outcome"), "scan_run_id", "competitor_id"))


SUPERSEDED_SQL = f"""WITH {RUNS_SQL}, old AS (
  SELECT id FROM runs WHERE status = 'running'
  QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY began DESC, id DESC) > 1)"""


@query("superseded_runs", f"""{SUPERSEDED_SQL} SELECT id FROM old""")
def superseded_runs(spark, sf):
    return S.superseded_runs(scan_runs(spark, sf)).select("id")


@query("fail_superseded", f"""{SUPERSEDED_SQL}
SELECT r.id, CASE WHEN o.id IS NULL THEN status ELSE 'failed' END AS status,
  CASE WHEN o.id IS NULL THEN error_summary ELSE coalesce(error_summary, '{S.SUPERSEDED_MESSAGE}') END AS error_summary FROM runs r LEFT JOIN old o ON o.id = r.id""")
def fail_superseded(spark, sf):
    return S.fail_superseded(scan_runs(spark, sf), now()).select("id", "status", "error_summary")


@query("close_scans", f"""WITH {RUNS_SQL}
SELECT 'run' AS kind, id, CASE WHEN status = 'running' THEN CASE WHEN k % 2 = 0 THEN 'success' WHEN ck % 3 = 0 THEN 'partial_success' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN status = 'running' THEN 9 ELSE k % 7 END::BIGINT AS new_count FROM runs
UNION ALL SELECT 'site', c.id, r.status, 0 FROM cust c LEFT JOIN (
  SELECT competitor_id, CASE WHEN k % 2 = 0 THEN 'success' WHEN ck % 3 = 0 THEN 'partial_success' ELSE 'failed' END AS status FROM runs WHERE status = 'running'
  QUALIFY row_number() OVER (PARTITION BY competitor_id ORDER BY began DESC, id DESC) = 1) r ON r.competitor_id = c.id""")
def close_scans(spark, sf):
    runs, sites = scan_runs(spark, sf), customers(spark, sf)
    key = F.col("id").cast("bigint")
    running = runs.filter(F.col("status") == "running")
    zero = F.lit(0).cast("bigint")
    status = S.scan_status(F.col("competitor_id").cast("bigint") % 3 == 0, key % 2 == 0)
    results = running.select(
        F.col("id").alias("scan_run_id"), "competitor_id", status.alias("status"), (key % 2 == 0).alias("is_complete"),
        zero.alias("sitemap_count"), zero.alias("total_url_count"), F.lit(9).cast("bigint").alias("new_count"),
        zero.alias("missing_count"), zero.alias("reappeared_count"), F.lit(None).cast("string").alias("error_summary"))
    after, _ = S.close_scans(runs, sites, results, now())
    newest = S.latest_scans(running).select(F.col("id").alias("scan_run_id"))
    _, touched = S.close_scans(runs, sites, results.join(newest, "scan_run_id", "left_semi"), now())
    return after.select(F.lit("run").alias("kind"), "id", "status", "new_count").unionByName(
        touched.select(F.lit("site").alias("kind"), "id", F.col("last_scan_status").alias("status"), zero.alias("new_count")))


@query("recent_scans", f"""WITH {RUNS_SQL}
(SELECT 'all' AS scope, r.id, c.name AS competitor_name, r.status, {I.stamp_sql('r.began')} AS started_at FROM runs r JOIN cust c ON c.id = r.competitor_id ORDER BY r.began DESC, r.id DESC LIMIT 10)
UNION ALL
(SELECT 'active', r.id, c.name, r.status, {I.stamp_sql('r.began')} FROM runs r JOIN cust c ON c.id = r.competitor_id WHERE NOT c.is_deleted ORDER BY r.began DESC, r.id DESC LIMIT 10)""")
def recent_scans(spark, sf):
    runs, sites = scan_runs(spark, sf), customers(spark, sf)

    def shown(rows, scope):
        return rows.select(F.lit(scope).alias("scope"), "id", "competitor_name", "status", I.stamp("started_at").alias("started_at"))

    return shown(S.recent_scans(runs, sites), "all").unionByName(shown(S.recent_scans(runs, sites, active_only=True), "active"))


@query("run_summary", """SELECT count(*) AS scanned_competitors, CAST(sum(o_orderkey % 7) AS BIGINT) AS new_pages FROM orders WHERE o_orderstatus = 'O'""")
def run_summary(spark, sf):
    return S.run_summary(scan_runs(spark, sf).filter(F.col("status") == "success"))


@query("review_upsert", f"""WITH {I.PAGE_REVIEW_SQL}, change AS (
  SELECT page_id, doc_id, '  note ' || doc_id || ' ' AS raw FROM page_review WHERE doc_id % 3 = 0 UNION ALL SELECT 'new_' || page_id, doc_id, '   ' FROM page_review WHERE doc_id % 5 = 0)
SELECT coalesce(c.page_id, r.page_id) AS page_id, CASE WHEN c.page_id IS NULL THEN r.review_status ELSE 'reviewed' END AS review_status,
  CASE WHEN c.page_id IS NULL THEN r.is_viewed ELSE TRUE END AS is_viewed, CASE WHEN c.page_id IS NULL THEN r.manual_page_type END AS manual_page_type,
  CASE WHEN c.page_id IS NOT NULL THEN nullif(trim(c.raw), '') END AS notes,
  CASE WHEN r.page_id IS NULL THEN '2024-01-20 12:00:00' ELSE '2024-01-05 00:00:00' END AS created_at,
  CASE WHEN c.page_id IS NULL THEN NULL ELSE '2024-01-20 12:00:00' END AS reviewed_at
FROM page_review r FULL OUTER JOIN change c ON c.page_id = r.page_id""")
def review_upsert(spark, sf):
    review = I.page_review(spark, sf)
    key = F.col("page_id").cast("bigint")

    def change(rows, page, note):
        none = F.lit(None).cast("string")
        return rows.select(
            page.alias("page_id"), F.lit("reviewed").alias("review_status"), F.lit(True).alias("is_viewed"), F.lit(False).alias("is_worth_following"),
            F.lit(" ").alias("manual_page_type"), none.alias("manual_primary_keyword"), F.array().cast("array<string>").alias("manual_secondary_keywords"),
            none.alias("manual_search_intent"), note.alias("notes"))

    changes = change(review.filter(key % 3 == 0), F.col("page_id"), F.concat(F.lit("  note "), "page_id", F.lit(" "))).unionByName(
        change(review.filter(key % 5 == 0), F.concat(F.lit("new_"), "page_id"), F.lit("   ")))
    after = R.upsert_review(review, changes, F.lit(I.AS_OF).cast("timestamp"))
    return after.select(
        "page_id", "review_status", "is_viewed", "manual_page_type", "notes", I.stamp("created_at").alias("created_at"),
        I.stamp("reviewed_at").alias("reviewed_at"))


def supplier_sources(spark, sf):
    """Line items as sitemap sources of their part's supplier-sized share of customers."""
    key = F.col("o_orderkey")
    t = F.col("o_orderdate").cast("timestamp")
    url = F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.com/s"), key.cast("string"), F.lit(".xml"))
    return conform(I.read(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("competitor_id"), url.alias("url"), url.alias("normalized_url"),
        F.when(key % 2 == 0, F.lit("manual")).otherwise(F.lit("robots")).alias("source_type"), F.lit(True).alias("is_enabled"),
        F.lit(False).alias("is_discovered"), t.alias("created_at"), t.alias("updated_at")), "sitemap_sources")


def customer_state(spark, sf):
    t = F.lit("1998-02-01T00:00:00Z").cast("timestamp")
    key = F.col("o_orderkey")
    pages = conform(I.read(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("competitor_id"), F.lit("u").alias("original_url"),
        key.cast("string").alias("normalized_url"), F.lit("u").alias("current_url"), F.lit("active").alias("lifecycle_status"), F.lit(0).alias("missing_streak"),
        t.alias("first_seen_at"), t.alias("last_seen_at"), t.alias("created_at"), t.alias("updated_at"), F.when(key % 13 == 0, t).alias("deleted_at")), "pages")
    return {"competitors": customers(spark, sf), "sitemap_sources": supplier_sources(spark, sf), "scan_runs": scan_runs(spark, sf), "pages": pages}


DELETE_SQL = f"""WITH {RUNS_SQL}, asked AS (SELECT CAST(c_custkey * 2 AS VARCHAR) AS id FROM customer),
busy AS (SELECT DISTINCT competitor_id FROM runs WHERE status = 'running'),
checked AS (SELECT a.id, CASE WHEN c.id IS NULL OR c.is_deleted THEN 'COMPETITOR_NOT_FOUND' WHEN a.id IN (SELECT competitor_id FROM busy) THEN 'COMPETITOR_SCAN_RUNNING' END AS code
  FROM asked a LEFT JOIN cust c ON c.id = a.id),
gone AS (SELECT id FROM checked WHERE code IS NULL)"""


@query("soft_delete", f"""{DELETE_SQL}
SELECT 'competitor' AS kind, id, CASE WHEN id IN (SELECT id FROM gone) THEN '1998-06-01 00:00:00' WHEN is_deleted THEN '1998-01-01 00:00:00' END AS mark FROM cust
UNION ALL SELECT 'source', id, CASE WHEN competitor_id IN (SELECT id FROM gone) THEN 'off' ELSE 'on' END FROM runs
UNION ALL SELECT 'page', id, CASE WHEN k % 13 = 0 THEN '1998-02-01 00:00:00' WHEN competitor_id IN (SELECT id FROM gone) THEN '1998-06-01 00:00:00' END FROM runs
UNION ALL SELECT 'reject', id, code FROM checked WHERE code IS NOT NULL""")
def soft_delete(spark, sf):
    ids = customers(spark, sf).select((F.col("id").cast("bigint") * 2).cast("string").alias("id"))
    after, rejects = C.soft_delete(customer_state(spark, sf), ids, now())
    parts = [
        after["competitors"].select(F.lit("competitor").alias("kind"), "id", I.stamp("deleted_at").alias("mark")),
        after["sitemap_sources"].select(F.lit("source").alias("kind"), "id", F.when(F.col("is_enabled"), F.lit("on")).otherwise(F.lit("off")).alias("mark")),
        after["pages"].select(F.lit("page").alias("kind"), "id", I.stamp("deleted_at").alias("mark")),
        rejects.select(F.lit("reject").alias("kind"), "id", F.col("code").alias("mark")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


CREATE_SQL = f"""WITH {RUNS_SQL}, asked AS (
  SELECT 'Supplier ' || s_suppkey AS name, 'https://WWW.c' || s_suppkey || '.Example.com/' AS asked, 'c' || s_suppkey || '.example.com' AS domain FROM supplier
  UNION ALL SELECT 'Part ' || p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'bad domain' ELSE 'p' || p_partkey % 50 || '.example.com' END,
    CASE WHEN p_partkey % 7 <> 0 THEN 'p' || p_partkey % 50 || '.example.com' END FROM part),
active AS (SELECT 'c' || k || '.example.com' AS domain FROM cust WHERE NOT is_deleted),
ranked AS (SELECT *, CASE WHEN domain IS NULL THEN 'COMPETITOR_DOMAIN_INVALID' WHEN domain IN (SELECT domain FROM active) THEN 'COMPETITOR_DOMAIN_CONFLICT' END AS code,
  row_number() OVER (PARTITION BY domain ORDER BY name, asked) AS rn FROM asked)"""


@query("create_competitors", f"""{CREATE_SQL}
SELECT 'created' AS kind, name, domain FROM ranked WHERE code IS NULL AND rn = 1
UNION ALL SELECT coalesce(code, 'COMPETITOR_DOMAIN_CONFLICT'), name, asked FROM ranked WHERE code IS NOT NULL OR rn > 1
UNION ALL SELECT 'source', name, 'https://' || domain || '/sitemap.xml' FROM ranked WHERE code IS NULL AND rn = 1""")
def create_competitors(spark, sf):
    suppliers = I.read(spark, sf, "supplier").select(
        F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("https://WWW.c"), F.col("s_suppkey").cast("string"), F.lit(".Example.com/")).alias("domain"))
    pk = F.col("p_partkey")
    parts = I.read(spark, sf, "part").select(
        F.concat(F.lit("Part "), pk.cast("string")).alias("name"),
        F.when(pk % 7 == 0, F.lit("bad domain")).otherwise(F.concat(F.lit("p"), (pk % 50).cast("string"), F.lit(".example.com"))).alias("domain"))
    new = suppliers.unionByName(parts)
    host = F.regexp_replace(F.regexp_replace(F.lower("domain"), "^https://(www[.])?", ""), "/$", "")
    sitemap = F.concat(F.lit("https://"), host, F.lit("/sitemap.xml"))
    new = new.withColumn("sitemap_urls", F.array(sitemap, F.concat(sitemap, F.lit("?utm_source=x"))))
    state = {"competitors": customers(spark, sf), "sitemap_sources": empty_table(spark, "sitemap_sources")}
    after, rejects = C.create_competitors(state, new, now())
    created = after["competitors"].filter(F.startswith("id", F.lit("cmp_")))
    names = created.select(F.col("id").alias("competitor_id"), "name")
    sources = after["sitemap_sources"].join(names, "competitor_id").select(
        F.lit("source").alias("kind"), "name", F.col("normalized_url").alias("domain"))
    return created.select(F.lit("created").alias("kind"), "name", "domain").unionByName(
        rejects.select(F.col("code").alias("kind"), "name", "domain")).unionByName(sources)


UPDATE_SQL = f"""WITH {RUNS_SQL}, one AS (
  SELECT c_custkey AS c, c_custkey + 1 AS k, CASE WHEN c_custkey % 20 IN (0, 4, 8) THEN 'n' || c_custkey // 20 || '.example.net' ELSE
    CASE c_custkey % 4 WHEN 0 THEN 'n' || c_custkey || '.example.org' WHEN 1 THEN 'c' || c_custkey + 1 || '.example.com' WHEN 2 THEN 'c' || c_custkey + 3 || '.example.com' ELSE '' END END AS domain FROM customer),
asked AS (SELECT k, CAST(k AS VARCHAR) AS id, domain FROM one UNION SELECT k, CAST(k AS VARCHAR), 'zz' || k // 100 || '.example.org' FROM one WHERE c % 10 = 5),
ranked AS (SELECT *, domain <> 'c' || k || '.example.com' AS changed, row_number() OVER (PARTITION BY id ORDER BY nullif(domain, '') NULLS LAST) AS ask FROM asked),
alone AS (SELECT a.*, CASE WHEN c.id IS NULL OR c.is_deleted THEN 'COMPETITOR_NOT_FOUND' WHEN ask > 1 THEN 'COMPETITOR_ASKED_TWICE' WHEN a.domain = '' THEN 'COMPETITOR_DOMAIN_INVALID'
    WHEN changed AND a.k % 3 = 0 THEN 'COMPETITOR_DOMAIN_FROZEN'
    WHEN changed AND a.domain IN (SELECT 'c' || k || '.example.com' FROM cust WHERE NOT is_deleted) THEN 'COMPETITOR_DOMAIN_CONFLICT' END AS own
  FROM ranked a LEFT JOIN cust c ON c.id = a.id),
wins AS (SELECT domain, min(id) AS winner FROM alone WHERE own IS NULL AND changed GROUP BY 1),
checked AS (SELECT a.id, a.k, a.domain, a.changed, coalesce(own, CASE WHEN changed AND a.id <> winner THEN 'COMPETITOR_DOMAIN_CONFLICT' END) AS code FROM alone a LEFT JOIN wins USING (domain)),
ok AS (SELECT * FROM checked WHERE code IS NULL)"""


@query("update_competitors", f"""{UPDATE_SQL}
SELECT 'competitor' AS kind, c.id, coalesce(ok.domain, 'c' || c.k || '.example.com') AS value FROM cust c LEFT JOIN ok ON ok.id = c.id
UNION ALL SELECT 'reject', id, code FROM checked WHERE code IS NOT NULL
UNION ALL SELECT 'source', r.id, CASE WHEN ok.id IS NULL OR NOT ok.changed AND r.k % 2 = 1 THEN 'on' ELSE 'off' END FROM runs r LEFT JOIN ok ON ok.id = r.competitor_id
UNION ALL SELECT 'added', ok.id, 'https://' || domain || '/new.xml' FROM ok""")
def update_competitors(spark, sf):
    """Every customer asks for another one; some ask twice, some for a domain that others ask for as well, some the same again."""
    key = F.col("id").cast("bigint")
    text = key.cast("string")
    domain = (
        F.when((key % 20).isin(0, 4, 8), F.concat(F.lit("n"), F.expr("CAST(CAST(id AS BIGINT) DIV 20 AS STRING)"), F.lit(".example.net")))
        .when(key % 4 == 0, F.concat(F.lit("n"), text, F.lit(".example.org")))
        .when(key % 4 == 1, F.concat(F.lit("c"), (key + 1).cast("string"), F.lit(".example.com")))
        .when(key % 4 == 2, F.concat(F.lit("c"), (key + 3).cast("string"), F.lit(".example.com"))).otherwise(F.lit(""))
    )
    rows = customers(spark, sf)
    second = F.concat(F.lit("zz"), F.expr("CAST((CAST(id AS BIGINT) + 1) DIV 100 AS STRING)"), F.lit(".example.org"))
    asks = rows.withColumn("domain", domain)
    asks = asks.unionByName(asks.filter(key % 7 == 0)).unionByName(rows.filter(key % 10 == 5).withColumn("domain", second))
    changes = asks.select(
        (key + 1).cast("string").alias("id"), F.lit(" New ").alias("name"), "domain", F.lit(True).alias("is_enabled")
    ).withColumn("sitemap_urls", F.array(F.concat(F.lit("https://"), "domain", F.lit("/new.xml"))))
    after, rejects = C.update_competitors(customer_state(spark, sf), changes, now())
    sources = after["sitemap_sources"]
    added = F.startswith("id", F.lit("smp_"))
    parts = [
        after["competitors"].select(F.lit("competitor").alias("kind"), "id", F.col("domain").alias("value")),
        rejects.select(F.lit("reject").alias("kind"), "id", F.col("code").alias("value")),
        sources.filter(~added).select(F.lit("source").alias("kind"), "id", F.when(F.col("is_enabled"), F.lit("on")).otherwise(F.lit("off")).alias("value")),
        sources.filter(added).select(F.lit("added").alias("kind"), F.col("competitor_id").alias("id"), F.col("normalized_url").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("domain_conflicts", """
SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 >= 2)""")
def domain_conflicts(spark, sf):
    candidates = I.read(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat(F.lit("c"), (F.col("s_suppkey") + 1).cast("string"), F.lit(".example.com")).alias("domain"))
    return C.domain_conflicts(candidates, customers(spark, sf)).select("id")


@query("exists_running", "SELECT count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'F'")
def exists_running(spark, sf):
    return C.exists_any(scan_runs(spark, sf).filter(F.col("status") == "running"))


@query("quality_rules", f"""WITH {RUNS_SQL}
SELECT 'scan_runs' AS "table", 'unique:competitor_id' AS rule, count(*) AS violations FROM (SELECT competitor_id FROM runs WHERE status = 'running' GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'pages', 'enum:lifecycle_status', count(*) FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'pages', 'foreign_key:first_scan_run_id', count(*) FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT 'page_analyses', 'range:confidence', count(*) FROM lineitem WHERE l_quantity > 40
UNION ALL SELECT 'page_analyses', 'not_null:model', count(*) FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT 'page_analyses', 'unique:id', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'page_analyses', 'foreign_key:page_id', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""")
def quality_rules(spark, sf):
    state = customer_state(spark, sf)
    key = F.col("id").cast("bigint")
    pages = state["pages"].withColumns({
        "lifecycle_status": F.when(key % 11 == 0, F.lit("lost")).otherwise(F.col("lifecycle_status")),
        "first_scan_run_id": F.when(key % 17 == 0, F.lit("none")).otherwise(F.col("id")),
    })
    t = F.col("l_shipdate").cast("timestamp")
    analyses = conform(I.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("page_id"), F.lit("success").alias("status"),
        F.lit("p").alias("provider"), F.when(F.col("l_linenumber") != 3, F.lit("m")).alias("model"), F.lit("v").alias("prompt_version"),
        (F.col("l_quantity") / 40).alias("confidence"), t.alias("created_at")), "page_analyses")
    found = Q.check_schema({"competitors": state["competitors"], "scan_runs": state["scan_runs"], "pages": pages, "page_analyses": analyses})
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


@query("input_rules", """
WITH bad AS (
  SELECT doc_id, unnest([CASE WHEN length(trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE source END)) NOT BETWEEN 1 AND 100 THEN 'length:name' END,
    CASE WHEN length(trim(lang)) NOT BETWEEN 1 AND 253 THEN 'length:domain' END, CASE WHEN doc_id % 13 > 10 THEN 'size:sitemap_urls' END,
    CASE WHEN doc_id % 6 = 0 AND doc_id % 13 > 0 THEN 'url:sitemap_urls' END]) AS rule FROM documents)
SELECT doc_id::VARCHAR AS key, rule FROM bad WHERE rule IS NOT NULL""")
def input_rules(spark, sf):
    did = F.col("doc_id")
    url = F.when(did % 6 == 0, F.lit("not a url")).otherwise(F.lit("https://example.com/s.xml"))
    rows = I.read(spark, sf, "documents").select(
        did, F.when(did % 2 == 0, F.col("text")).otherwise(F.col("source")).alias("name"), F.col("lang").alias("domain"),
        F.array_repeat(url, (did % 13).cast("int")).alias("sitemap_urls"))
    return Q.check_inputs(rows, Q.competitor_rules(), F.col("doc_id")).select("key", "rule")


@query("input_rules_review", """
WITH bad AS (
  SELECT doc_id, unnest([CASE WHEN doc_id % 5 = 0 THEN 'enum:review_status' END, CASE WHEN length(text) > 5000 THEN 'length:notes' END,
    CASE WHEN doc_id % 30 > 20 THEN 'size:manual_secondary_keywords' END, CASE WHEN doc_id % 4 = 0 AND doc_id % 30 > 0 THEN 'length:manual_secondary_keywords' END,
    CASE WHEN doc_id % 8 = 0 THEN 'range:page_size' END, CASE WHEN length(text) > 500 THEN 'length:query' END]) AS rule
  FROM (SELECT doc_id, rtrim(ltrim(text, chr(10) || chr(9) || ' '), chr(10) || chr(9) || ' ') AS text FROM documents))
SELECT doc_id::VARCHAR AS key, rule FROM bad WHERE rule IS NOT NULL""")
def input_rules_review(spark, sf):
    did = F.col("doc_id")
    none = F.lit(None).cast("string")
    trimmed = F.regexp_replace("text", r"^[\n\t ]+|[\n\t ]+$", "")
    rows = I.read(spark, sf, "documents").select(
        did, did.cast("string").alias("page_id"), F.when(did % 5 == 0, F.lit("maybe")).otherwise(F.lit("reviewed")).alias("review_status"),
        F.lit(True).alias("is_viewed"), F.lit(False).alias("is_worth_following"), none.alias("manual_page_type"), none.alias("manual_primary_keyword"),
        F.array_repeat(F.when(did % 4 == 0, F.lit(" ")).otherwise(F.lit("k")), (did % 30).cast("int")).alias("manual_secondary_keywords"),
        none.alias("manual_search_intent"), trimmed.alias("notes"), none.alias("competitor_id"), none.alias("page_type"), none.alias("search_intent"),
        F.concat(trimmed, F.lit(" ")).alias("query"), F.lit(1).alias("page"), F.when(did % 8 == 0, 101).otherwise(20).alias("page_size"))
    filters = {k: v for k, v in Q.list_filter_rules().items() if k != "length:review_status"}
    return Q.check_inputs(rows, Q.review_rules() | filters, F.col("doc_id")).select("key", "rule")


@query("sitemap_hosts", f"""SELECT page_id, page_id % 2 = 0 AS ok FROM pages""")
def sitemap_hosts(spark, sf):
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://sub."), I.host(), F.lit("/s.xml"))).otherwise(F.lit("https://example.edu/"))
    rows = I.read(spark, sf, "pages").select("page_id", I.host().alias("domain"), F.array("url", other).alias("sitemap_urls"))
    return Q.check_sitemap_hosts(rows).select("page_id", "ok")


@query("sources_of_scan", """
WITH newest AS (SELECT o_orderkey, o_custkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1)
SELECT CAST(r.o_orderkey AS VARCHAR) AS scan_run_id, CAST(s.o_orderkey AS VARCHAR) AS source_id FROM orders s JOIN newest r ON s.o_custkey = r.o_custkey""")
def sources_of_scan(spark, sf):
    newest = S.latest_scans(scan_runs(spark, sf))
    return sources_for(newest, supplier_sources(spark, sf)).select("scan_run_id", "source_id")


@query("manual_urls", """
SELECT CAST(o_custkey AS VARCHAR) AS competitor_id, 'https://c' || o_custkey || '.example.com/s' || o_orderkey || '.xml' AS url,
  row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), o_orderdate, 's' || o_orderkey || '.xml') - 1 AS place FROM orders WHERE o_orderkey % 2 = 0""")
def manual_sitemaps(spark, sf):
    return placed(manual_urls(supplier_sources(spark, sf))).select("competitor_id", "url", "place")


@query("fetch_targets", """
SELECT CAST(o_orderkey AS VARCHAR) AS page_id, CAST(o_custkey AS VARCHAR) AS competitor_id, 'u' AS url, 'c' || o_custkey || '.example.com' AS domain
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey IN (SELECT c_custkey FROM customer)""")
def targets(spark, sf):
    ids = I.read(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").cast("string").alias("page_id"))
    state = customer_state(spark, sf)
    return fetch_targets(ids, state["pages"], state["competitors"])


@query("pages_without_event", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS page_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)""")
def pages_without_event(spark, sf):
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.lit("baseline_added")).otherwise(F.col("event_type"))
    log = I.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("page_id"), kind.alias("event_type"))
    return without_event(log.select("page_id").distinct(), log, "baseline_added")


@query("event_log", """
SELECT event_type, count(*) AS events FROM (SELECT event_type FROM events WHERE event_type <> 'click'
  UNION ALL SELECT 'click_' || event_type FROM events WHERE event_type = 'click') GROUP BY 1""")
def event_log(spark, sf):
    log = I.page_events(spark, sf).withColumn(
        "event_type", F.when(F.col("event_type") == "discovered", F.lit("signup")).otherwise(F.col("event_type")))
    clicks = log.filter(F.col("event_type") == "click").withColumn("event_type", F.lit("click_click"))
    both = append_events(log.filter(F.col("event_type") != "click"), clicks)
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("pipeline_count_write", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS fetch_success_count FROM orders""")
def pipeline_count_write(spark, sf):
    runs = scan_runs(spark, sf)
    counters = runs.filter(F.col("id").cast("bigint") % 4 == 0).select(
        F.col("id").alias("scan_run_id"), F.lit(3).cast("bigint").alias("fetch_success_count"))
    return S.write_pipeline_counts(runs, counters).select("id", "fetch_success_count")


@query("fail_scans", """
SELECT 'site' AS kind, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 = 0) THEN 'failed' END AS status,
  CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 6 = 0) THEN 1 ELSE 0 END::BIGINT AS total_url_count, NULL AS error_summary FROM customer
UNION ALL SELECT 'run', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 6 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'running' WHEN o_orderstatus = 'O' THEN 'success' ELSE 'partial_success' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 1000 END AS total_url_count,
  CASE WHEN o_orderkey % 12 = 0 THEN 'Unknown scan error' WHEN o_orderkey % 6 = 0 THEN 'broken' WHEN o_orderkey % 10 = 0 THEN 'kept' END AS error_summary FROM orders""")
def fail_scans(spark, sf):
    runs = scan_runs(spark, sf)
    key = F.col("id").cast("bigint")
    failures = runs.filter(key % 6 == 0).select(
        F.col("id").alias("scan_run_id"), "competitor_id", F.when(key % 12 != 0, F.lit("broken")).alias("message"))
    after, sites = S.fail_scans(runs, customers(spark, sf), failures, now())
    at_now = F.coalesce(F.col("last_scanned_at") == now(), F.lit(False)).cast("bigint")
    return after.select(F.lit("run").alias("kind"), "id", "status", "total_url_count", "error_summary").unionByName(sites.select(
        F.lit("site").alias("kind"), "id", F.col("last_scan_status").alias("status"), at_now.alias("total_url_count"),
        F.lit(None).cast("string").alias("error_summary")))
