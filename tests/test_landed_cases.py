"""Cases in which landed data is repeated, nested, mistyped or late."""

import json

from pyspark.sql import functions as F

from sitetide.functions.html import extract_seo
from sitetide.operators.analysis import BAD_RESPONSE, analysis_content
from sitetide.operators.competitors import create_competitors
from sitetide.operators.fetches import fetch_outcome
from sitetide.operators.merge import merge_by_key, take
from sitetide.operators.redirects import resolve_redirects
from sitetide.operators.traversal import expand_sitemaps
from sitetide.schemas import TABLES, empty_table
from sitetide.sources.sitemaps import parse_sitemaps
from sitetide.streaming.lifecycle_stream import SCAN_SCHEMA, apply_batch, read_lifecycle_state


def landed(spark, rows):
    """rows: (competitor_id, url, status, location, body, landed_at)."""
    full = [(c, u, s, loc, "text/html", None, b, None) for c, u, s, loc, b, _ in rows]
    frame = spark.createDataFrame([(*f, r[5]) for f, r in zip(full, rows, strict=True)],
                                  "competitor_id string, url string, status int, location string, content_type string, content_length string, body string, error string, landed_at string")
    return frame.withColumn("landed_at", F.col("landed_at").cast("timestamp"))


def test_one_response_answers_a_request(spark):
    rows = [("c1", "https://a.org/x", 200, None, "old", "2024-01-01"), ("c1", "https://a.org/x", 200, None, "new", "2024-01-02"),
            ("c2", "https://a.org/x", 200, None, "other", "2024-01-03"), ("c1", "https://a.org/r", 301, "/x", None, "2024-01-01")]
    requests = spark.createDataFrame([(1, "c1", "https://a.org/x", "a.org"), (2, "c2", "https://a.org/x", "a.org"), (3, "c1", "https://a.org/r", "a.org")],
                                     "id int, competitor_id string, url string, domain string")
    got = {r.id: (r.body, r.final_url) for r in resolve_redirects(requests, landed(spark, rows), keys=["id"], by_competitor=True).collect()}
    assert got == {1: ("new", "https://a.org/x"), 2: ("other", "https://a.org/x"), 3: ("new", "https://a.org/x")}
    unowned = resolve_redirects(requests.drop("competitor_id"), landed(spark, rows), keys=["id"]).collect()
    assert len(unowned) == 3 and {r.body for r in unowned} == {"other"}


def test_a_later_answer_replaces_a_redirect(spark):
    rows = [("c", "https://a.org/r", 301, "/x", None, "2024-01-01"), ("c", "https://a.org/r", 200, None, "here", "2024-01-02")]
    requests = spark.createDataFrame([(1, "c", "https://a.org/r", "a.org")], "id int, competitor_id string, url string, domain string")
    assert [r.body for r in resolve_redirects(requests, landed(spark, rows), keys=["id"]).collect()] == ["here"]


def test_body_timeout_comes_after_status_and_type(spark):
    rows = [(404, "text/html", "RESPONSE_BODY_TIMEOUT"), (200, "application/pdf", "RESPONSE_BODY_TIMEOUT"), (200, "text/html", "RESPONSE_BODY_TIMEOUT"),
            (None, None, "TimeoutError")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, status int, content_type string, error string").selectExpr(
        "*", "CAST(NULL AS STRING) AS content_length", "CAST(NULL AS STRING) AS body", "CAST(NULL AS STRING) AS error_code")
    got = {r.id: (r.code, r.http_status, r.fetch_status) for r in fetch_outcome(frame).collect()}
    assert got == {0: ("PAGE_HTTP_ERROR", 404, "failed"), 1: ("PAGE_UNSUPPORTED_CONTENT_TYPE", 200, "unsupported"),
                   2: ("PAGE_FETCH_TIMEOUT", None, "failed"), 3: ("PAGE_FETCH_TIMEOUT", None, "failed")}


def test_nested_locations_are_not_the_page_url(spark):
    xml = "<urlset a='b'><url><loc>a</loc><video:video><loc>v</loc></video:video></url><url><loc>b</loc><loc>c</loc></url><url><x><loc>n</loc></x></url></urlset>"
    docs = spark.createDataFrame([("d", xml)], "document string, body string")
    assert [r.loc for r in parse_sitemaps(docs, ["document"]).entries.collect()] == ["a"]


def test_references_behind_the_wanted_element_do_not_matter(spark):
    good = '<meta name="description" content="d"><meta name="robots" content="r"><link rel="canonical" href="/c">'
    bad = '<meta name="&#ab;" content="x"><link rel="&#ab;" href="/y">'
    pages = spark.createDataFrame([(1, good + bad), (2, bad + good)], "id int, body string").withColumn("url", F.lit("https://a.org/p"))
    got = {r.id: (r.meta_description, r.seo_error is None) for r in extract_seo(pages, "body", "url").collect()}
    assert got[1] == ("d", True) and got[2][1] is False


def test_response_types_are_checked(spark):
    good = [{"choices": [{"message": {"content": "x"}}]}, {"choices": [{"message": {"content": [{"text": "x"}, {"type": "y"}]}}]}]
    bad = [{"choices": [{"message": {"content": [{"text": 5}]}}]}, {"choices": [{"message": {"content": "x"}}], "error": None},
           {"choices": {}}, {"choices": ["x"]}, {"choices": [{"message": {"content": 7}}]}, {"choices": [], "error": {"message": 1}}, [1]]
    rows = [(i, json.dumps(d)) for i, d in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "id int, body string").withColumn("r", analysis_content("body", F.lit(200)))
    got = {r.id: (r.r.content, r.r.error) for r in frame.collect()}
    assert [got[i] for i in range(len(good))] == [("x", None), ("x", None)]
    assert {got[i] for i in range(len(good), len(rows))} == {(None, BAD_RESPONSE)}


def test_identical_asks_are_all_answered(spark):
    new = spark.createDataFrame([("A", "a.org", []), ("A", "a.org", []), ("B", "a.org", [])], "name string, domain string, sitemap_urls array<string>")
    state = {name: empty_table(spark, name) for name in TABLES}
    change = create_competitors(state, new, F.lit("2024-01-01").cast("timestamp"))
    assert change.state["competitors"].count() == 1 and change.rejects.count() == 2


def test_merges_update_insert_and_keep(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    changes = spark.createDataFrame([(2, "B", 9), (3, "c", 8), (None, "m", 7)], "k int, v string, z int")
    rules = {"matched": {"v": take("v")}, "inserted": {"w": lambda old, new: F.coalesce(old["w"], new["z"])}}
    got = sorted(map(tuple, merge_by_key(target, changes, ["k"], **rules).collect()), key=str)
    assert got == sorted([(1, "a", 1), (2, "B", 2), (None, "n", 3), (3, "c", 8), (None, "m", 7)], key=str)
    assert merge_by_key(target, changes, ["k"], insert=False, **rules).count() == 3


def test_large_sites_come_out_whole(spark):
    """More sitemaps, URLs and levels than a live crawler would take."""
    chain = [("c", "a.org", f"https://a.org/i{k}.xml", f"<sitemapindex><sitemap><loc>https://a.org/i{k + 1}.xml</loc></sitemap>"
              + "".join(f"<sitemap><loc>https://a.org/s{k}-{j}.xml</loc></sitemap>" for j in range(14)) + "</sitemapindex>") for k in range(9)]
    chain.append(("c", "a.org", "https://a.org/i9.xml", "<sitemapindex><sitemap><loc>https://a.org/i0.xml</loc></sitemap></sitemapindex>"))
    leaves = [("c", "a.org", f"https://a.org/s{k}-{j}.xml", "<urlset x='y'>" + "".join(f"<url><loc>https://a.org/{k}/{j}/{n}</loc></url>" for n in range(90)) + "</urlset>")
              for k in range(9) for j in range(14)]
    docs = spark.createDataFrame(chain + leaves, "competitor_id string, domain string, url string, body string").selectExpr(
        "*", "200 AS status", "CAST(NULL AS STRING) AS content_length", "CAST(NULL AS STRING) AS error", "CAST(NULL AS STRING) AS error_source")
    seeds = spark.createDataFrame([("c", "a.org", "src", "https://a.org/i0.xml", 0)], "competitor_id string, domain string, source_id string, url string, seed_order int")
    out = expand_sitemaps(seeds, docs)
    assert out.entries.count() == 9 * 14 * 90 > 10_000
    assert out.visits.filter("status = 'success'").count() == 10 + 9 * 14


def test_a_scan_waits_for_its_last_row(spark, tmp_path):
    def rows(scan, day, urls, n):
        return [(scan, "c", day, True, f"https://a.org/{u}", f"https://a.org/{u}", None, None, n) for u in urls]

    def batch(parts):
        frame = spark.createDataFrame(parts, SCAN_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace("scanned_at:timestamp", "scanned_at:string"))
        return frame.withColumn("scanned_at", F.col("scanned_at").cast("timestamp")).select(*SCAN_SCHEMA.names)

    root = str(tmp_path / "state")
    apply_batch(batch(rows("s1", "2024-01-01", "ab", 2) + rows("s2", "2024-01-02", "a", 3)), 0, root)
    pages = lambda: {r.normalized_url[-1]: (r.lifecycle_status, r.missing_streak) for r in read_lifecycle_state(spark, root)["pages"].collect()}
    assert pages() == {"a": ("baseline", 0), "b": ("baseline", 0)}
    apply_batch(batch(rows("s3", "2024-01-03", "abc", 3)), 1, root)  # later, and whole: it waits for s2
    assert pages() == {"a": ("baseline", 0), "b": ("baseline", 0)}
    apply_batch(batch(rows("s2", "2024-01-02", "bc", 3)), 2, root)
    assert pages() == {"a": ("active", 0), "b": ("active", 0), "c": ("active", 0)}
    state = read_lifecycle_state(spark, root)
    assert state["pending"].count() == 0 and state["applied_scans"].count() == 3
    assert sorted(r.event_type for r in state["page_events"].collect()) == ["baseline_added", "baseline_added", "discovered"]
