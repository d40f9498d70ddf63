"""Queries on tables of another make or size than the test data: each against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sitetide.functions import urls
from sitetide.operators import joins, quality, redirects
from sitetide.operators.joins import join_dimension
from sitetide.plans.scan import process_new_pages
from sitetide.queries import scan_queries
from sitetide.schemas import TABLES, conform, empty_table
from sitetide.session import cut_lineage
from sitetide.sources import sitemaps


def differing(spark, folder, name):
    """Rows that only the query and only its SQL return, as text."""
    df = contract.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    return sorted(map(str, got)), sorted(map(str, want))


@pytest.fixture(scope="module")
def twice_listed(spark, tmp_path_factory):
    """Pages 5 and 20 (unknown) are two spellings of one URL, pages 1 and 4 (known) of another; each pair is in one sitemap."""
    folder = tmp_path_factory.mktemp("twice")
    urls = {5: "x", 20: "x#top", 1: "y", 4: "y?utm_source=feed", 2: "z", 13: "z/"}
    spark.createDataFrame([(k, f"https://a.example.com/{urls.get(k, k)}", "") for k in range(1, 30)], "page_id bigint, url string, html string").write.parquet(
        str(folder / "pages.parquet"))
    events = spark.range(8).select(
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 2, "click").otherwise("view").alias("event_type"),
        F.lit("{}").alias("props"), F.lit(1.0).alias("value"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("ts"))
    events.write.parquet(str(folder / "events.parquet"))
    return folder


@pytest.mark.parametrize("name", ["baseline_events", "baseline_links", "baseline_pages"])
def test_url_listed_in_two_spellings(spark, twice_listed, name):
    got, want = differing(spark, twice_listed, name)
    assert got == want


def test_repeated_dimension_counts_its_rows(spark, tmp_path):
    """What Spark takes the repeated dimension for is no less than its rows: it must not send a large one through the driver."""
    spark.range(1 << 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name")).write.parquet(str(tmp_path / "d"))
    dimension = spark.read.parquet(str(tmp_path / "d"))
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    joined = join_dimension(spark.range(1 << 16), dimension, ["id"], ["id"])
    repeated = joined._jdf.queryExecution().optimizedPlan()
    while str(repeated.nodeName()) != "Join":
        repeated = repeated.children().head()
    assert int(str(repeated.right().stats().sizeInBytes())) >= 16 * size(dimension)


@pytest.mark.parametrize("few", [1 << 16, 1])
def test_schema_rules_write_no_rows(spark, monkeypatch, few):
    """Only distinct orphaned references are written, however many rows there are; few or many of them find the same rows."""
    t = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    competitors = conform(spark.range(20).select(
        F.col("id").cast("string"), F.lit("n").alias("name"), F.concat(F.lit("d"), (F.col("id") / 2).cast("int").cast("string")).alias("domain"),
        F.lit(True).alias("is_enabled"), F.lit(False).alias("baseline_established"), t.alias("created_at"), t.alias("updated_at")), "competitors")
    n = F.col("id")
    url = F.concat(F.lit("u"), F.when(n == 7, 8).otherwise(n).cast("string"))
    pages = conform(spark.range(3000).select(
        F.when(n == 9, 10).otherwise(n).cast("string").alias("id"), F.when(n % 2 == 0, F.lit("gone")).otherwise((n % 21).cast("string")).alias("competitor_id"),
        url.alias("original_url"), url.alias("normalized_url"), url.alias("current_url"), F.when(n == 5, F.lit("lost")).otherwise(F.lit("new")).alias("lifecycle_status"),
        F.when(n != 6, F.lit(0)).alias("missing_streak"), t.alias("first_seen_at"), t.alias("last_seen_at"), t.alias("created_at"), t.alias("updated_at")), "pages")
    written = []
    monkeypatch.setattr(quality, "cut_lineage", lambda df: (written.append(df.count()), cut_lineage(df))[1])
    monkeypatch.setattr(quality, "HOT_KEYS", few, raising=False)
    found = quality.check_schema({"competitors": competitors, "pages": pages}).groupBy("table", "rule").count().collect()
    assert {(r["table"], r["rule"]): r["count"] for r in found} == {
        ("competitors", "unique:domain"): 10, ("pages", "enum:lifecycle_status"): 1, ("pages", "not_null:missing_streak"): 1,
        ("pages", "unique:id"): 1, ("pages", "foreign_key:competitor_id"): 1500 + sum(k % 21 == 20 for k in range(1, 3000, 2))}
    assert written == [2]


def test_redirects_write_where_requests_end(spark, monkeypatch):
    """Where requests end is asked for twice and found once: it is written before the landed table is read for it."""
    written = []
    monkeypatch.setattr(redirects, "cut_lineage", lambda df: (written.append(df.columns), cut_lineage(df))[1])
    url = F.concat(F.lit("https://a.example.com/"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    responses = spark.range(10).select(
        url.alias("url"), F.when(F.col("id") < 3, 301).otherwise(200).alias("status"), F.when(F.col("id") < 3, F.concat(F.lit("/"), (F.col("id") + 1).cast("string"))).alias("location"),
        none.alias("content_type"), none.alias("content_length"), F.col("id").cast("string").alias("body"), none.alias("error"))
    requests = spark.range(12).select("id", url.alias("url"), F.lit("example.com").alias("domain"))
    out = {r["id"]: r["body"] for r in redirects.resolve_redirects(requests, responses).collect()}
    assert out == {k: str(max(k, 3)) if k < 10 else None for k in range(12)}
    assert any("final_url" in columns for columns in written)


def test_rooted_references_resolve_alike(spark):
    """The short way for plain root paths gives what the whole parser gives, and leaves all else to it."""
    bases = ["https://a.example.com/x/y?q#f", "http://a.example.com", "https://A.example.com/x", "https://u:p@a.example.com/x", "https://a.example.com:8443/x",
             "https://1.2.3.4/x", " https://a.example.com/x", "https://a.example.com\\x", "https://a.example.com?x", "nonsense", "https://a.example.com\n"]
    hrefs = ["/", "/o/1", "/o/../1", "/%2e/1", "/a b", "//b.example.com/1", "/\\b", "/o?x=1", "/o#f", "/o\n", "/\u00e9", "o/1", "", "/.", "/a/.b", "/%41'|[]"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    both = F.struct(urls.parse_http_url("base").alias("base"), F.col("href").alias("ref"))
    target = urls.apply_sql(both, urls._JOINER)
    other = target.rlike(urls._SCHEME) & ~target.rlike("(?i)^https?:")
    whole = F.when(other, target).otherwise(urls.canonical_url(target))
    wrong = df.select("base", "href", urls.resolve_url("href", "base").alias("got"), whole.alias("want")).filter(~F.expr("got <=> want")).collect()
    assert wrong == []


def test_urls_in_normal_form_are_inspected_alike(spark):
    """The short way for URLs in normal form gives what the whole parser gives, and leaves all else to it."""
    hosts = ["a.example.com", "example.com", "A.example.com", "www.example.com", "evil.example", "localhost", "x.localhost", "localhost.localdomain",
             "1.2.3.4", "a.1", "u:p@a.example.com", "a.example.com:443", "a.example.com:8443", "a_b.example.com", "ä.example.com", "a.example.com.", ""]
    tails = ["", "/", "/x", "/x/", "//x", "/x//y", "/x/../y", "/.x", "/%2e/x", "/%41'|[]", "/x?", "/x?b=2&a=1", "/x#f", "/a b", "/x\n", "/x\\y", "/é"]
    texts = [f"{s}://{h}{t}" for s in ("http", "https", "HTTPS", "ftp") for h in hosts for t in tails] + ["", "x", "/x", " https://a.example.com/x", None]
    df = spark.createDataFrame([(u, d) for u in texts for d in ("example.com", "a.example.com", "localhost", None)], "url string, domain string")
    parsed = urls.parse_http_url("url")
    whole = urls.let(parsed, lambda p: F.struct(urls.normalize_parts(p).alias("normalized_url"), urls.guard_parts(p, F.col("url"), "domain").alias("reason")))
    both = df.select("url", "domain", urls.inspect_url("url", "domain").alias("got"), whole.alias("want"), urls.normalize_url("url").alias("normal"))
    assert both.filter(~F.expr("got <=> want AND normal <=> want.normalized_url")).collect() == []
    assert spark.range(1).select(F.lit("https://a.example.com/x/y").rlike(urls._NORMAL)).first()[0]


def test_plain_nodes_are_read_alike(spark):
    """The pattern for plain nodes gives what their children give, and these are found once a node."""
    locs = ["https://a.example.com/x", "http://a/?x=1&amp;y=<b>", " https://a.example.com/x ", "https://a.example.com/é", "true", "12", "", "<![CDATA[https://a/x]]>", "https://a b"]
    mods = ["", "<lastmod>2024-01-02</lastmod>", "<lastmod>2024</lastmod>", "<lastmod>2024-</lastmod>\n", "<lastmod>2024-1</lastmod><lastmod>2024-2</lastmod>",
            "<lastmod a='1'>2024-01-02</lastmod>", "<lastmod></lastmod>", "<lastmod/>", "<loc>https://b/x</loc>", "<x>1</x>"]
    nodes = [f"{head}{loc}</loc>{gap}{mod}" for head in ("<loc>", "\n <loc>", "<loc >", "<loc a='1'>") for loc in locs for gap in ("", "\n ", "t") for mod in mods]
    df = spark.createDataFrame([(f"<urlset><url>{n}</url></urlset>",) for n in [*nodes, "", "<loc/>"]], "xml string")
    for decode in (False, True):
        got = df.select("xml", sitemaps.sitemap_nodes(F.col("xml"), "url", decode).alias("nodes"))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sitemaps, "_PLAIN_NODE", "a^")
            want = df.select("xml", sitemaps.sitemap_nodes(F.col("xml"), "url", decode).alias("want"))
        assert got.join(want, "xml").filter(~F.expr("nodes <=> want")).collect() == []
    plan = str(df.select(sitemaps.sitemap_nodes(F.col("xml"), "url").alias("nodes"))._jdf.queryExecution().analyzed())
    assert plan.count("regexp_extract_all") <= 4


def test_scan_reads_written_tables(spark, monkeypatch):
    """What a scan reads many times is not derived anew each time, and tables without rows take no part in its jobs."""
    seen = []
    monkeypatch.setattr(scan_queries, "run_scans", lambda state, landed, *args, **kw: seen.append((state, landed)))
    scan_queries.scanned(spark, "/root/testdata/sf0.001")
    state, landed = seen[0]
    plan = lambda df: str(df._jdf.queryExecution().optimizedPlan())
    for table in (state["competitors"], state["sitemap_sources"], state["pages"], landed["sitemaps"], landed["roots"]):
        assert "Relation" not in plan(table)
    assert plan(state["page_events"]).startswith("LocalRelation <empty>")


def test_no_chains_without_redirects(spark, monkeypatch):
    """Where no response redirects no chain is looked for; a redirect status without a location is none."""
    written = []
    monkeypatch.setattr(redirects, "cut_lineage", lambda df: (written.append(df.columns), cut_lineage(df))[1])
    url = F.concat(F.lit("https://a.example.com/"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    responses = spark.range(4).select(
        url.alias("url"), F.when(F.col("id") == 1, 301).otherwise(200).alias("status"), none.alias("location"), none.alias("content_type"),
        none.alias("content_length"), F.col("id").cast("string").alias("body"), none.alias("error"))
    requests = spark.range(5).select("id", F.when(F.col("id") == 3, "https://b.example.net/").otherwise(url).alias("url"), F.lit("example.com").alias("domain"))
    out = {r["id"]: (r["status"], r["body"], r["error_code"], r["redirect_chain"]) for r in redirects.resolve_redirects(requests, responses).collect()}
    assert out == {0: (200, "0", None, []), 1: (301, "1", None, []), 2: (200, "2", None, []), 3: (None, None, "OUTBOUND_REFUSED", []), 4: (None, None, "NOT_LANDED", [])}
    assert len(written) == 1 and "_chain" not in written[0]


@pytest.mark.parametrize("sent, join", [(1 << 24, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_bodies_that_nobody_asks_for_stay(spark, monkeypatch, sent, join):
    """A few URLs that are asked for are sent to the landed table, whatever Spark takes both for; many meet it in a shuffle."""
    monkeypatch.setattr(joins, "SENT_BYTES", sent, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        url = F.concat(F.lit("https://a.example.com/"), F.col("id").cast("string"))
        none = F.lit(None).cast("string")
        responses = spark.range(100).select(
            url.alias("url"), F.lit(200).alias("status"), none.alias("location"), none.alias("content_type"), none.alias("content_length"),
            F.repeat(F.col("id").cast("string"), 100).alias("body"), none.alias("error"))
        requests = spark.range(98, 102).select("id", url.alias("url"), F.lit("example.com").alias("domain"))
        out = redirects.resolve_redirects(requests, responses)
        semi = [line for line in str(out._jdf.queryExecution().sparkPlan()).splitlines() if "LeftSemi" in line]
        assert len(semi) == 1 and join in semi[0]
        assert {r["id"]: r["body"] for r in out.collect()} == {98: "98" * 100, 99: "99" * 100, 100: None, 101: None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_without_new_pages_no_landed_page_is_read(spark):
    state = {name: empty_table(spark, name) for name in TABLES}
    none = F.raise_error(F.lit("read")).cast("string")
    landed = spark.range(3).select(none.alias("url"), none.cast("int").alias("status"), *[
        none.alias(c) for c in ("location", "content_type", "content_length", "body", "error")])
    new_pages = spark.createDataFrame([], "page_id string, scan_run_id string")
    after, counters = process_new_pages(state, new_pages, landed, F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    assert after == state and counters.collect() == []
    assert counters.columns == [
        "scan_run_id", "fetch_success_count", "fetch_failed_count", "analysis_success_count", "analysis_failed_count"]
