"""Example cases for single operators, with the inputs and results a reader can check by hand."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sitetide.functions import text as X
from sitetide.functions import times as T
from sitetide.functions.jsons import json_or_raw, json_string_array
from sitetide.operators import analysis as A
from sitetide.operators import competitors as C
from sitetide.operators import diff as D
from sitetide.operators import fetches as P
from sitetide.operators import lifecycle as L
from sitetide.operators import scans as S
from sitetide.operators.metrics import metrics_events
from sitetide.operators.pages import filter_pages
from sitetide.schemas import TABLES, conform, empty_table
from sitetide.sources.export import BOM, export_pages

T0 = datetime(2026, 7, 16, 1, tzinfo=timezone.utc)


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def state(spark, **tables):
    return {name: empty_table(spark, name) for name in TABLES} | tables


def frame(spark, table, *rows):
    defaults = {"string": "x", "boolean": False, "integer": 0, "long": 0, "timestamp": T0, "double": 0.0}
    full = [
        {f.name: row.get(f.name, None if f.nullable else defaults.get(f.dataType.typeName())) for f in TABLES[table].fields}
        for row in rows
    ]
    return spark.createDataFrame(full, TABLES[table])


# --- scan diff -------------------------------------------------------------------------------------


def page(**kw):
    return {"id": "page-1", "competitor_id": "c", "normalized_url": "https://example.com/a", "current_url": "https://example.com/a",
            "lifecycle_status": "active", "missing_streak": 0} | kw


def changes(spark, urls, pages, complete):
    current = spark.createDataFrame(
        [("c", u, u, None, "s") for u in urls],
        "competitor_id string, normalized_url string, url string, lastmod string, source_url string")
    scans = spark.createDataFrame([("c", "scan", complete)], "competitor_id string, scan_run_id string, is_complete boolean")
    diff = D.scan_diff(current, frame(spark, "pages", *pages), scans)
    return sorted((r["change_type"], r["normalized_url"]) for r in diff.collect())


A_URL, NEW_URL = "https://example.com/a", "https://example.com/new"


@pytest.mark.parametrize("urls,pages,complete,expected", [
    ([A_URL, NEW_URL], [page()], True, [("new", NEW_URL), ("present", A_URL)]),
    ([], [page()], False, []),
    ([A_URL, NEW_URL], [page()], False, [("present", A_URL)]),
    ([], [page()], True, [("first_missing", A_URL)]),
    ([], [page(missing_streak=1)], True, [("confirmed_missing", A_URL)]),
    ([A_URL], [page(lifecycle_status="missing", missing_streak=2)], True, [("reappeared", A_URL)]),
    ([A_URL], [page(lifecycle_status="missing", missing_streak=2)], False, [("reappeared", A_URL)]),
    ([], [page(lifecycle_status="missing", missing_streak=2)], True, []),
])
def test_scan_diff(spark, urls, pages, complete, expected):
    assert changes(spark, urls, pages, complete) == expected


# --- replay against a plain state machine ------------------------------------------------------------


def machine(scans, seen):
    state, events, based = {}, [], False
    for no, complete in scans:
        listed = seen.get(no, set())
        if not based and not complete:
            continue
        for url in listed:
            if url not in state:
                if complete:
                    state[url] = ["baseline" if not based else "new", 0]
                    events.append((url, no, "baseline_added" if not based else "discovered"))
            elif state[url][0] == "missing":
                state[url] = ["reappeared", 0]
                events.append((url, no, "reappeared"))
            else:
                state[url] = ["active", 0]
        if complete:
            for url, entry in state.items():
                if url not in listed and entry[0] != "missing":
                    entry[1] += 1
                    if entry[1] >= 2:
                        entry[0] = "missing"
                        events.append((url, no, "missing_confirmed"))
            based = True
    return state, sorted(events)


def test_replay_matches_state_machine(spark):
    rng = random.Random(3)
    scans, sightings, expected = [], [], {}
    for c in range(60):
        rounds = [(i * 3, rng.random() > 0.25) for i in range(rng.randint(2, 14))]
        seen = {no: {f"u{k}" for k in range(8) if rng.random() < 0.5} for no, _ in rounds}
        scans += [(f"c{c}", no, complete) for no, complete in rounds]
        sightings += [(f"c{c}", u, no) for no, urls in seen.items() for u in urls for _ in range(rng.randint(1, 2))]
        expected[f"c{c}"] = machine(rounds, seen)
    out = L.lifecycle_replay(
        spark.createDataFrame(scans, "competitor_id string, scan_no bigint, is_complete boolean"),
        spark.createDataFrame(sightings, "competitor_id string, url string, scan_no bigint"),
        bucket=F.floor(F.col("scan_no") / 7))
    states, events = {}, {}
    for r in out.state.collect():
        states.setdefault(r["competitor_id"], {})[r["url"]] = [r["lifecycle_status"], r["missing_streak"]]
    for r in out.events.collect():
        events.setdefault(r["competitor_id"], []).append((r["url"], r["scan_no"], r["event_type"]))
    for c, (final, log) in expected.items():
        assert states.get(c, {}) == final
        assert sorted(events.get(c, [])) == log


# --- small functions -------------------------------------------------------------------------------


# Inputs and results that define the cell rule and the business day.
@pytest.mark.parametrize("value,expected", [
    ('=HYPERLINK("https://attacker.example")', '"\'=HYPERLINK(""https://attacker.example"")"'),
    ("  +SUM(1,1)", '"\'  +SUM(1,1)"'), ('SEO "keyword"', '"SEO ""keyword"""'), ("a-b", '"a-b"'), ("", '""'),
])
def test_csv_cell(spark, value, expected):
    assert one(spark, X.csv_cell(F.lit(value))) == expected


@pytest.mark.parametrize("now,start", [
    ("2026-07-16T15:59:59Z", "2026-07-15T16:00:00.000Z"), ("2026-07-16T16:00:00Z", "2026-07-16T16:00:00.000Z"),
    ("1988-07-16T16:00:00Z", "1988-07-16T16:00:00.000Z"),
])
def test_business_day(spark, now, start):
    assert one(spark, T.iso_utc(T.shanghai_day_start(T.moment(now)))) == start


def test_json_columns(spark):
    assert one(spark, json_string_array(F.lit('["a", 1, null, "b", {"c": 1}]'))) == ["a", "b"]
    assert one(spark, json_string_array(F.lit('{"a": 1}'))) == [] == one(spark, json_string_array(F.lit("[oops")))
    assert one(spark, json_or_raw(F.lit('{"a": 1}'))) == '{"a":1}'
    assert one(spark, json_or_raw(F.lit('say "hi"'))) == '"say \\"hi\\""'
    assert one(spark, json_or_raw(F.lit(""))) is None


def test_metrics_count_discovered_events(spark):
    events = frame(spark, "page_events",
                   {"event_type": "discovered", "detected_at": datetime(2026, 7, 15, 16, tzinfo=timezone.utc)},
                   {"event_type": "discovered", "detected_at": datetime(2026, 7, 10, tzinfo=timezone.utc)},
                   {"event_type": "baseline_added", "detected_at": T0})
    assert metrics_events(events, T.moment(T0)).first().asDict() == {"today_new": 1, "seven_day_new": 2}
    assert metrics_events(events.limit(0), T.moment(T0)).first().asDict() == {"today_new": 0, "seven_day_new": 0}


def test_search_folds_ascii_only(spark):
    rows = spark.createDataFrame(
        [("https://e.com/ABC", None, None), ("https://e.com/x", "Été 100%", None), ("https://e.com/y", None, "back\\slash")],
        "url string, title string, primary_keyword string")

    def hits(q):
        return [r["url"][-1] for r in filter_pages(rows, query=q).collect()]

    assert hits("abc") == ["C"] and hits("ét") == [] and hits("ÉT") == ["x"]
    assert hits("1_0%") == ["x"] and hits("k\\s") == ["y"] and hits(" ") == ["C", "x", "y"]


# --- competitors and scan runs ---------------------------------------------------------------------


def test_domain_conflict_is_refused(spark):
    st = state(spark, competitors=frame(spark, "competitors", {"id": "cmp_1", "domain": "example.com"}))
    new = spark.createDataFrame(
        [(" A ", "HTTPS://EXAMPLE.COM/", []), ("B", "www.other.com", ["https://other.com/s.xml", "https://other.com/s.xml?utm_id=1"])],
        "name string, domain string, sitemap_urls array<string>")
    after, rejects = C.create_competitors(st, new, T.moment(T0))
    assert [(r["name"], r["code"]) for r in rejects.collect()] == [("A", C.CONFLICT)]
    assert sorted(r["domain"] for r in after["competitors"].collect()) == ["example.com", "other.com"]
    assert [r["url"] for r in after["sitemap_sources"].collect()] == ["https://other.com/s.xml?utm_id=1"]


def test_running_scan_blocks_and_stale_one_is_recovered(spark):
    runs = frame(spark, "scan_runs",
                 {"id": "scan_running", "competitor_id": "cmp_1", "status": "running", "started_at": T0},
                 {"id": "scan_old", "competitor_id": "cmp_2", "status": "running", "started_at": datetime(2026, 7, 15, tzinfo=timezone.utc)})
    requests = spark.createDataFrame([("cmp_1", "manual"), ("cmp_2", "manual")], "competitor_id string, trigger_type string")
    after, opened, rejects = S.open_scans(runs, requests, T.moment(T0))
    assert [(r["competitor_id"], r["scan_run_id"]) for r in rejects.collect()] == [("cmp_1", "scan_running")]
    assert [r["competitor_id"] for r in opened.collect()] == ["cmp_2"]
    old = after.filter("id = 'scan_old'").first()
    assert (old["status"], old["error_summary"], old["is_complete"]) == ("failed", S.STALE_MESSAGE, False)


def test_error_summary_is_ordered_and_clipped(spark):
    rows = [("c", f"{i:08X}", f"u{i}", "failed", "m" * 40, None) for i in range(500)] + [("c", "0", "ok", "success", None, None)]
    df = spark.createDataFrame(rows, "competitor_id string, path string, url string, status string, error_message string, error_code string")
    lines = "\n".join(f"u{i}: " + "m" * 40 for i in range(500))
    for n in (4000, None):
        assert S.error_summary(df, ["competitor_id"], n).first()["error_summary"] == lines[:n]


# --- analysis --------------------------------------------------------------------------------------

VALID = {
    "pageType": "product", "primaryTopic": "epoxy mixing", "primaryKeyword": "nozzle", "secondaryKeywords": ["mixer"],
    "searchIntent": "commercial", "productLine": "mixing nozzles", "summary": "s", "reasoningEvidence": ["e"], "confidence": 0.95,
}


@pytest.mark.parametrize("change,violations", [
    ({}, []), ({"productLine": None}, []), ({"productLine": ...}, ["productLine"]), ({"pageType": "home"}, ["pageType"]),
    ({"confidence": 1}, []), ({"confidence": 1.01}, ["confidence"]), ({"confidence": "1"}, ["confidence"]),
    ({"secondaryKeywords": ["k"] * 16}, ["secondaryKeywords"]), ({"secondaryKeywords": []}, []), ({"secondaryKeywords": [1]}, ["secondaryKeywords"]),
    ({"reasoningEvidence": []}, ["reasoningEvidence"]), ({"summary": ""}, ["summary"]), ({"primaryTopic": "x" * 201}, ["primaryTopic"]),
])
def test_validation(spark, change, violations):
    doc = {k: v for k, v in (VALID | change).items() if v is not ...}
    row = one(spark, A.validate_analysis(F.lit(json.dumps(doc))))
    assert (row["violations"], row["is_valid"]) == (violations, not violations)
    if not violations:
        assert row["result"]["primary_keyword"] == "nozzle" and row["result"]["evidence"] == ["e"]


@pytest.mark.parametrize("body,status,content,error", [
    ('{"choices":[{"message":{"content":" hi "}}]}', 200, "hi", None),
    ('{"choices":[{"message":{"content":[{"text":"a"},{"x":1},{"text":"b "}]}}]}', 200, "ab", None),
    ('{"error":{"message":"quota"}}', 429, None, "quota"), ("{}", 503, None, "OpenRouter returned HTTP 503"),
    ('{"choices":[{"message":{"content":"  "}}]}', 200, None, A.NO_CONTENT), ("x" * 300_000, 200, None, "Response exceeds 256000 bytes"),
    ("nope", 200, None, A.BAD_JSON),
])
def test_response_reading(spark, body, status, content, error):
    row = one(spark, A.analysis_content(F.lit(body), F.lit(status), A.RESPONSE_MAX_BYTES))
    assert (row["content"], row["error"]) == (content, error)


def test_payload_limits(spark):
    pages = frame(spark, "pages", {"id": "p", "current_url": "https://e.com/"})
    seo = frame(spark, "page_seo_data", {"page_id": "p", "fetch_status": "success", "title": "T", "h2": ["h"] * 25, "content_excerpt": "x" * 8500})
    whole = json.loads(A.analysis_input(pages, seo).first()["payload"])
    assert (len(whole["h2"]), len(whole["contentExcerpt"])) == (25, 8500)
    payload = json.loads(A.analysis_input(pages, seo, max_h2=20, max_chars=8000).first()["payload"])
    assert list(payload) == ["retryNumber", "url", "title", "metaDescription", "h1", "h2", "pageLanguage", "contentExcerpt"]
    assert (len(payload["h2"]), len(payload["contentExcerpt"]), payload["h1"]) == (20, 8000, None)


def test_one_bad_payload_fails_alone(spark):
    def ask(payloads):
        if any("bad" in p for p in payloads):
            raise ValueError("no answer")
        return payloads.str.upper()

    inputs = spark.createDataFrame([(str(i), "bad" if i == 7 else f"p{i}") for i in range(20)], "page_id string, payload string").coalesce(1)
    got = {r.page_id: (r.http_status, r.body) for r in A.analyze(inputs, A.batched(ask)).collect()}
    assert got.pop("7") == (500, '{"error": {"message": "no answer"}}')
    assert got == {str(i): (200, f"P{i}") for i in range(20) if i != 7}


# --- fetches ---------------------------------------------------------------------------------------


def test_failed_fetch_keeps_earlier_text(spark):
    seo = frame(spark, "page_seo_data", {"page_id": "p", "title": "Old", "h2": ["x"], "fetch_status": "success", "http_status": 200})
    fetched = spark.createDataFrame(
        [("p", "s", "https://e.com/", "https://e.com/", [], 500, "text/html", None, "<title>New</title>", None, None),
         ("q", "s", "https://e.com/q", "https://e.com/q", [], 200, "text/html", None, "<title>Q</title>", None, None),
         ("r", "s", "https://e.com/r", "https://e.com/r", [], 200, "text/html", None, "123456789012345678", None, None)],
        "page_id string, scan_run_id string, url string, final_url string, redirect_chain array<string>, status int, content_type string, "
        "content_length string, body string, error_code string, error string")
    results = P.fetch_results(fetched, max_bytes=17)
    rows = {r["page_id"]: r for r in P.upsert_fetch(seo, results, T.moment(T0)).collect()}
    assert (rows["p"]["title"], rows["p"]["h2"], rows["p"]["fetch_status"], rows["p"]["fetch_error"]) == ("Old", ["x"], "failed", "HTTP 500")
    assert (rows["q"]["title"], rows["q"]["fetch_error"]) == ("Q", None)
    assert rows["r"]["fetch_error"] == "Response exceeds 17 bytes"


def test_export_file(spark, tmp_path):
    row = {c: None for c in ("title", "fetch_status", "analysis_status", "page_type", "primary_keyword", "search_intent")}
    df = spark.createDataFrame(
        [("1", T0, "A", "https://e.com/1", "active", "unreviewed", True), ("2", datetime(2026, 7, 17, tzinfo=timezone.utc), "A", "=x", "new", "reviewed", False)],
        "id string, first_seen_at timestamp, competitor_name string, url string, lifecycle_status string, review_status string, is_worth_following boolean")
    df = df.select("*", *[F.lit(v).cast("string").alias(k) for k, v in row.items()])
    export_pages(df, str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("part-*")).read_bytes().decode("utf-8")
    lines = raw.split("\r\n")
    assert lines[0].startswith(BOM + '"First Seen","Competitor"') and len(lines) == 4
    assert lines[1].startswith('"2026-07-17T00:00:00.000Z","A","\'=x","","new"') and lines[2].endswith('"unreviewed","yes"')
