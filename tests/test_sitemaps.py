import random

import pytest
from pyspark.sql import functions as F

from sitetide.operators.redirects import resolve_redirects
from sitetide.operators.traversal import CRAWLER_LIMITS, Limits, expand_sitemaps, scan_complete
from sitetide.sources import sitemaps as S

DOMAIN = "example.com"
BASE = "https://example.com"


def docs_frame(spark, docs):
    rows = [("c1", DOMAIN, url, status, None, body, None, None) for url, (status, body) in docs.items()]
    return spark.createDataFrame(
        rows, "competitor_id string, domain string, url string, status int, content_length string, body string, "
              "error string, error_source string")


def seeds_frame(spark, urls):
    return spark.createDataFrame(
        [("c1", DOMAIN, f"s{i}", u, i) for i, u in enumerate(urls)],
        "competitor_id string, domain string, source_id string, url string, seed_order int")


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def parse_one(spark, xml, **kw):
    row = S.parse_documents(spark.createDataFrame([(xml,)], "body string"), **kw).first()
    return row["doc_type"], [(n["loc"], n["lastmod"]) for n in row["nodes"]], row["parse_error"]


PARSED = [
    ('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/a</loc>'
     '<lastmod>2026-07-01</lastmod></url>\n<url><loc>https://e.com/b</loc></url></urlset>',
     ("urlset", [("https://e.com/a", "2026-07-01"), ("https://e.com/b", None)], None)),
    ('<sitemapindex xmlns="x"><sitemap><loc>https://e.com/p.xml</loc></sitemap><sitemap><loc> https://e.com/b.xml '
     '</loc></sitemap></sitemapindex>', ("sitemapindex", [("https://e.com/p.xml", None), ("https://e.com/b.xml", None)], None)),
    ("<rss></rss>", (None, [], S.UNSUPPORTED_XML)),
    ("", (None, [], S.UNSUPPORTED_XML)),
    ("<urlset/>", (None, [], S.UNSUPPORTED_XML)),
    ("<urlset></urlset>", (None, [], S.UNSUPPORTED_XML)),
    ("<urlset>text</urlset>", (None, [], S.UNSUPPORTED_XML)),
    ('<urlset xmlns="x"/>', ("urlset", [], None)),
    ('<urlset xmlns="x"></urlset>', ("urlset", [], None)),
    ("<urlsets><url><loc>https://e.com/</loc></url></urlsets>", (None, [], S.UNSUPPORTED_XML)),
    ("<!-- <rss> --><urlset><url><loc><![CDATA[ https://e.com/?a=1&b=2 ]]></loc></url></urlset>",
     ("urlset", [("https://e.com/?a=1&b=2", None)], None)),
    ("<urlset><url><loc>2026</loc></url><url><loc a='1'>https://e.com/x</loc></url><url><loc>u</loc><loc>v</loc></url>"
     "<url><loc> </loc></url><url>t</url><url/><url><loc>https://e.com/z</loc><lastmod>2026</lastmod></url></urlset>",
     ("urlset", [("https://e.com/z", None)], None)),
    ("<urlset><url><loc>https://e.com/?a=1&amp;b=2</loc></url></urlset>", ("urlset", [("https://e.com/?a=1&amp;b=2", None)], None)),
]


@pytest.mark.parametrize("xml,expected", PARSED)
def test_parse(spark, xml, expected):
    assert parse_one(spark, xml) == expected


def test_parse_decoding(spark):
    xml = "<urlset><url><loc>https://e.com/?a=1&amp;b=2</loc></url></urlset>"
    assert parse_one(spark, xml, decode_entities=True)[1] == [("https://e.com/?a=1&b=2", None)]


def test_robots_and_roots(spark):
    body = ("User-agent: *\r\n sitemap : https://example.com/b.xml?utm_source=r \r\nSitemap: https://evil.example/x.xml\n"
            "Sitemap: nope\nSITEMAP:https://example.com/sitemap.xml\nSitemap: https://example.com/b.xml\nSitemap: a b")
    robots = S.parse_robots(spark.createDataFrame(
        [("c1", DOMAIN, 200, body, None, None), ("c2", "other.example", 404, "Sitemap: https://other.example/a.xml", None, None),
         ("c3", "big.example", 200, "Sitemap: https://big.example/a.xml\n" + "x" * 250_000, None, None)],
        "competitor_id string, domain string, status int, body string, content_length string, error string"), S.ROBOTS_MAX_BYTES)
    landed = spark.createDataFrame(
        [("c1", f"{BASE}/sitemap.xml", 200, None, "<URLSET x>", None), ("c1", f"{BASE}/wp-sitemap.xml", 200, None, "<sitemapindex>", None),
         ("c1", f"{BASE}/sitemap_index.xml", 200, None, "<urlset>" + " " * 4096, None)],
        "competitor_id string, url string, status int, content_length string, body string, error string")
    common = S.probe_common_paths(spark.createDataFrame([("c1", DOMAIN)], "competitor_id string, domain string"), landed, S.PREVIEW_MAX_BYTES)
    roots = S.root_candidates(robots, common).orderBy("root_order").collect()
    assert [(r["normalized_url"], r["url"], r["source_type"]) for r in roots] == [
        (f"{BASE}/b.xml", f"{BASE}/b.xml", "robots"),
        (f"{BASE}/sitemap.xml", f"{BASE}/sitemap.xml", "robots"),
        (f"{BASE}/wp-sitemap.xml", f"{BASE}/wp-sitemap.xml", "common_path"),
    ]


def test_redirects(spark):
    landed = [(None, f"{BASE}/{i}", 301, f"/{i + 1}", None, None, None, None) for i in range(6)]
    landed += [
        (None, f"{BASE}/6", 200, None, "text/html", None, "six", None),
        (None, f"{BASE}/off", 302, "https://attacker.example/x", None, None, None, None),
        (None, f"{BASE}/ip", 302, "http://169.254.169.254/", None, None, None, None),
        (None, f"{BASE}/bad", 302, "http://a b/", None, None, None, None),
        (None, f"{BASE}/noloc", 302, None, None, None, "x", None),
        (None, f"{BASE}/ok", 200, None, "text/html", None, "ok", None),
    ]
    responses = spark.createDataFrame(
        landed, "competitor_id string, url string, status int, location string, content_type string, "
                "content_length string, body string, error string")
    urls = ["0", "1", "off", "ip", "bad", "noloc", "ok", "gone"]
    requests = spark.createDataFrame([(u, f"{BASE}/{u}", DOMAIN) for u in urls], "k string, url string, domain string")
    out = {r["k"]: r for r in resolve_redirects(requests, responses).collect()}
    assert (out["0"]["error"], out["0"]["redirect_chain"], out["0"]["status"]) == ("More than 5 redirects", [], 301)
    assert out["1"]["redirect_chain"] == [f"{BASE}/{i}" for i in range(2, 7)] and out["1"]["body"] == "six"
    assert out["1"]["final_url"] == f"{BASE}/6"
    assert out["off"]["error"].startswith("Outbound host attacker.example") and out["off"]["final_url"] == f"{BASE}/off"
    assert out["ip"]["error"].startswith("Private") and out["bad"]["error"] == "Invalid URL"
    assert out["noloc"]["status"] == 302 and out["noloc"]["error"] is None
    assert out["ok"]["body"] == "ok" and out["gone"]["error_code"] == "NOT_LANDED"


def test_overlapping_sets_count_a_page_once(spark):
    docs = {
        f"{BASE}/main.xml": (200, index(f"{BASE}/spring.xml", f"{BASE}/autumn.xml", f"{BASE}/spring.xml")),
        f"{BASE}/spring.xml": (200, urlset(f"{BASE}/tulip?gclid=7", f"{BASE}/crocus", f"{BASE}/tulip")),
        f"{BASE}/autumn.xml": (200, urlset("https://evil.example/aster", f"{BASE}/crocus/", f"{BASE}/dahlia", ":")),
    }
    out = expand_sitemaps(seeds_frame(spark, [f"{BASE}/main.xml"]), docs_frame(spark, docs))
    found = {r["normalized_url"]: r["source_url"] for r in out.entries.collect()}
    assert found == {f"{BASE}/tulip": f"{BASE}/spring.xml", f"{BASE}/crocus": f"{BASE}/spring.xml", f"{BASE}/dahlia": f"{BASE}/autumn.xml"}
    assert out.children.count() == 3
    visits = out.visits.orderBy("path").collect()
    assert [(v["status"], v["url_count"]) for v in visits] == [("success", 0), ("success", 2), ("success", 1), ("skipped", 0)]
    assert scan_complete(out.visits, ["competitor_id"]).first()["is_complete"]


def test_failures_make_the_scan_incomplete(spark):
    docs = {f"{BASE}/all.xml": (200, index("::", f"{BASE}/roses.xml", f"{BASE}/herbs.xml", f"{BASE}/gone.xml")),
            f"{BASE}/roses.xml": (429, "slow down"), f"{BASE}/herbs.xml": (200, "<html>")}
    out = expand_sitemaps(seeds_frame(spark, [f"{BASE}/all.xml"]), docs_frame(spark, docs))
    visits = out.visits.orderBy("path").collect()
    assert [(v["error_code"], v["error_message"], v["http_status"]) for v in visits] == [
        (None, None, 200), ("SITEMAP_URL_REJECTED", "Invalid URL", None), ("SITEMAP_HTTP_ERROR", "HTTP 429", 429),
        ("SITEMAP_FETCH_FAILED", S.UNSUPPORTED_XML, None), ("SITEMAP_FETCH_FAILED", "No landed response", None)]
    assert [c["url"] for c in out.children.orderBy("path").collect()] == [f"{BASE}/{n}.xml" for n in ("roses", "herbs", "gone")]
    assert not scan_complete(out.visits, ["competitor_id"]).first()["is_complete"]


def walk(seeds, docs, limits):
    """The walk's rules on small graphs, with a stack of (url, depth) still to be met."""
    within = lambda n, bound: bound is None or n < bound
    met, seen, owner = [], set(), {}
    ahead = [(url, 0) for url in reversed(seeds)]
    while ahead:
        url, depth = ahead.pop()
        rules = [
            ("SITEMAP_DEPTH_LIMIT", not within(depth - 1, limits.max_depth)),
            ("SITEMAP_COUNT_LIMIT", not within(len(seen), limits.max_sitemaps)),
            ("SITEMAP_URL_REJECTED", not url.startswith(BASE)),
            ("skipped", url in seen),
        ]
        broken = next((name for name, holds in rules if holds), None)
        if broken is None:
            seen.add(url)
            kind, items = docs.get(url, ("none", []))
            if kind == "index":
                ahead += [(child, depth + 1) for child in reversed(items)]
            new = [i for n, i in enumerate(items) if kind == "urls" and i.startswith(BASE) and i not in owner and i not in items[:n]]
            room = len(new) if limits.max_urls is None else limits.max_urls - len(owner)
            # the cap is noticed when an item follows the one that filled it
            filled = limits.max_urls is not None and kind == "urls" and len(new) >= room
            last_read = items.index(new[room - 1]) if filled and room else -1
            owner |= dict.fromkeys(new[:max(room, 0)], url)
            broken = "SITEMAP_FETCH_FAILED" if kind == "none" else "SITEMAP_URL_LIMIT" if filled and len(items) > last_read + 1 else None
            met.append((url, broken or len(new[:max(room, 0)])))
        else:
            met.append((url, broken))
    return met, owner


@pytest.mark.parametrize("limits", [Limits(), CRAWLER_LIMITS, Limits(2, 100, 10_000), Limits(3, 6, 5)])
def test_random_graphs_match_the_walk(spark, limits):
    rng = random.Random(repr(limits))
    all_seeds, all_docs, expected = [], [], {}
    for g in range(40):
        n = rng.randint(2, 14)
        names = [f"{BASE}/{i}.xml" for i in range(n)]
        docs = {}
        for i, name in enumerate(names):
            if rng.random() < 0.08:
                continue
            if rng.random() < 0.65:
                later = names[i + 1:] if g % 2 and names[i + 1:] else names
                picks = [rng.choice(later[: rng.choice([2, 4, 20])]) for _ in range(rng.randint(0, 4))]
                if rng.random() < 0.1:
                    picks.append("https://evil.example/s.xml")
                docs[name] = ("index", picks)
            else:
                docs[name] = ("urls", [rng.choice([f"{BASE}/p{rng.randint(0, 9)}", "https://evil.example/"])
                                       for _ in range(rng.randint(0, 5))])
        seeds = [rng.choice(names) for _ in range(rng.randint(1, 3))]
        cid = f"g{g}"
        expected[cid] = walk(seeds, docs, limits)
        all_seeds += [(cid, DOMAIN, f"s{i}", u, i) for i, u in enumerate(seeds)]
        for url, (kind, items) in docs.items():
            body = index(*items) if kind == "index" else urlset(*items)
            root = "<sitemapindex" if kind == "index" else "<urlset"
            all_docs.append((cid, DOMAIN, url, 200, None, body.replace(root, root + ' xmlns="x"', 1), None, None))
    seeds_df = spark.createDataFrame(
        all_seeds, "competitor_id string, domain string, source_id string, url string, seed_order int")
    docs_df = spark.createDataFrame(
        all_docs, "competitor_id string, domain string, url string, status int, content_length string, body string, "
                  "error string, error_source string")
    out = expand_sitemaps(seeds_df, docs_df, limits)
    visits, entries = {}, {}
    for r in out.visits.orderBy("competitor_id", "path").collect():
        outcome = r["status"] if r["status"] == "skipped" else (r["error_code"] or r["url_count"])
        visits.setdefault(r["competitor_id"], []).append((r["url"], outcome))
    for r in out.entries.collect():
        entries.setdefault(r["competitor_id"], {})[r["normalized_url"]] = r["source_url"]
    for cid, (processed, found) in expected.items():
        assert visits.get(cid, []) == processed, cid
        assert entries.get(cid, {}) == found, cid
