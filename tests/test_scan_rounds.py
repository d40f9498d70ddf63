"""Four scan rounds end to end: baseline; one URL added and one gone; still gone; back again."""

from sitetide.functions.times import moment
from sitetide.operators.analysis import rule_provider
from sitetide.plans.reports import dashboard, list_pages, page_detail
from sitetide.plans.scan import run_scans
from sitetide.schemas import LANDED, TABLES, empty_table

BASE = "https://example.com"


def responses(spark, rows):
    full = [{f.name: r.get(f.name) for f in LANDED["responses"].fields} for r in rows]
    return spark.createDataFrame(full, LANDED["responses"])


def landed(spark, urls):
    xml = "<urlset xmlns='x'>" + "".join(f"<url><loc>{BASE}/{u}</loc></url>" for u in urls) + "</urlset>"
    pages = [{"url": f"{BASE}/{u}", "status": 200, "content_type": "text/html", "body": f"<title>Page {u}</title><h1>H {u}</h1>"} for u in urls]
    site = {"competitor_id": "cmp_1", "url": f"{BASE}/sitemap.xml", "status": 200, "body": xml}
    return {"sitemaps": responses(spark, [site]), "roots": responses(spark, [site]), "pages": responses(spark, pages)}


def test_four_rounds(spark):
    state = {name: empty_table(spark, name) for name in TABLES}
    t = moment("2026-07-01T00:00:00Z")
    state["competitors"] = spark.range(1).selectExpr(
        "'cmp_1' AS id", "'A' AS name", "'example.com' AS domain", "true AS is_enabled", "false AS baseline_established",
        "CAST(NULL AS STRING) AS last_scan_status", "CAST(NULL AS TIMESTAMP) AS last_scanned_at").select(
        "*", t.alias("created_at"), t.alias("updated_at")).selectExpr("*", "CAST(NULL AS TIMESTAMP) AS deleted_at")
    expected = [
        (["a", "b"], (0, 0, 0), {"a": "baseline", "b": "baseline"}),
        (["a", "c"], (1, 0, 0), {"a": "active", "b": "baseline", "c": "new"}),
        (["a", "c"], (0, 1, 0), {"a": "active", "b": "missing", "c": "active"}),
        (["a", "b", "c"], (0, 0, 1), {"a": "active", "b": "reappeared", "c": "active"}),
    ]
    for day, (urls, counts, statuses) in enumerate(expected, start=10):
        result = run_scans(state, landed(spark, urls), f"2026-07-{day}T01:00:00Z", provider=rule_provider)
        summary = result.summaries.first()
        assert result.rejects.count() == 0 and summary["status"] == "success"
        assert (summary["new_count"], summary["missing_count"], summary["reappeared_count"]) == counts
        state = {name: spark.createDataFrame(df.collect(), TABLES[name]) for name, df in result.state.items()}
        found = {r["normalized_url"].rsplit("/", 1)[1]: r["lifecycle_status"] for r in state["pages"].collect()}
        assert found == statuses

    events = sorted(r["event_type"] for r in state["page_events"].collect())
    assert events == ["analysis_succeeded", "baseline_added", "baseline_added", "discovered", "missing_confirmed", "reappeared"]
    assert [r["source_type"] for r in state["sitemap_sources"].collect()] == ["common_path"]
    runs = state["scan_runs"].orderBy("created_at").collect()
    assert [(r["status"], r["fetch_success_count"], r["analysis_success_count"]) for r in runs] == [
        ("success", 0, 0), ("success", 1, 1), ("success", 0, 0), ("success", 0, 0)]
    assert state["competitors"].first()["baseline_established"]

    listed = list_pages(state)
    row = listed.items.first()
    assert listed.total.first()["total"] == 1 and (row["title"], row["primary_keyword"]) == ("Page c", "h c")
    detail, timeline = page_detail(state, row["id"])
    assert detail.first()["seo"]["h1"] == "H c" and timeline.count() == 2
    board = dashboard(state, "2026-07-13T02:00:00Z")
    assert board["recent_scans"].count() == 4 and board["new_pages"].first()["seven_day_new"] == 2
