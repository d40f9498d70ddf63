"""State that is written back by change, hot-key joins, cursors, chains and other parts that scale."""

import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitetide.operators import joins
from sitetide.operators import pages as P
from sitetide.operators.competitors import CONFLICT, REPEATED, update_competitors
from sitetide.operators.redirects import resolve_redirects
from sitetide.operators.sitemap_sources import seed_order
from sitetide.operators.windows import placed
from sitetide.schemas import TABLES, conform, empty_table
from sitetide.sources import state_store as store
from sitetide.streaming.lifecycle_stream import SCAN_SCHEMA, apply_batch, read_lifecycle_state

T0 = "CAST('2024-01-01' AS TIMESTAMP)"


def pages(spark, ids, status="new"):
    made = spark.createDataFrame([(str(i), f"https://a.org/{i}", status) for i in ids], "id string, url string, lifecycle_status string")
    return conform(made.selectExpr(
        "id", "'c' AS competitor_id", "url AS original_url", "url AS normalized_url", "url AS current_url", "lifecycle_status", "0 AS missing_streak",
        f"{T0} AS first_seen_at", f"{T0} AS last_seen_at", f"{T0} AS created_at", f"{T0} AS updated_at"), "pages")


def files(root):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("part-*.parquet")}


def statuses(spark, root):
    return {r.id: r.lifecycle_status for r in store.stored_tables(spark, root)["pages"].collect()}


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    root = str(tmp_path / "state")
    assert store.state_version(spark, root) == 0 and store.stored_tables(spark, root)["pages"].count() == 0
    first = store.write_state({"pages": pages(spark, range(200)), "page_events": empty_table(spark, "page_events")}, root, buckets=16)
    before = files(root)
    assert first.version == 1 and len(first.buckets["pages"]) == 16 and first.buckets["page_events"] == []
    changed = store.write_changes({"pages": pages(spark, [3, 500, 501], "active")}, root)
    after = files(root)
    assert before.items() <= after.items()  # no file was changed
    assert len(after) - len(before) == len(changed.buckets["pages"]) <= 3
    assert statuses(spark, root) == {str(i): "new" for i in range(200)} | {i: "active" for i in ("3", "500", "501")}
    assert store.write_changes({"pages": pages(spark, [])}, root).buckets == {"pages": []}
    for i in range(10):
        store.write_changes({"pages": pages(spark, [i], "missing")}, root)
    assert store.state_version(spark, root) == 13
    assert Counter(statuses(spark, root).values()) == {"new": 190, "missing": 10, "active": 2}
    # a table that is first named by a change
    store.write_changes({"competitors": spark.createDataFrame([], TABLES["competitors"])}, root)
    assert store.stored_tables(spark, root)["competitors"].count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "state")
    store.write_state({"pages": pages(spark, range(5))}, root)
    with pytest.raises(store.StaleVersionError):
        store._swap(spark, root, 1, {})
    assert len(statuses(spark, root)) == 5


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_like_others(spark, how):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 2 else f"k{rng.randrange(40)}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{j}", j) for j in range(0, 40, 2)], (None, 7)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    for bound in (10, 100_000):
        got = joins.join_hot(left, right, ["k"], ["i"], how, hot_rows=bound)
        assert sorted(map(tuple, got.collect()), key=str) == want
    hot = joins.hot_keys(left.dropna().groupBy("k").agg(F.count("*").alias("n")), ["k"], hot_rows=100).collect()
    assert [(r.k, r._salts) for r in hot] == [("hot", 15)]


def test_cursors_and_numbers_give_the_same_pages(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(f"p{i:03}", start + timedelta(hours=rng.choice([0, 0, 5, 30, 90]))) for i in range(157)]
    frame = spark.createDataFrame(rows, "id string, first_seen_at timestamp")
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    cursor, seen, number = None, [], 0
    while True:
        page = P.next_page(frame, cursor, 25)
        ids = [r.id for r in page.collect()]
        number += 1
        assert [r.id for r in P.paginate(frame, number, 25).collect()] == ids
        cursor = P.cursor_of(page)
        if cursor is None:
            break
        seen += ids
    assert seen == order and P.paginate(frame, 1, 150).count() == 150


def test_chains_of_any_length_and_rings(spark):
    base = "https://a.org/"
    to = {f"c{i}": f"c{i + 1}" for i in range(8)} | {"r0": "r1", "r1": "r2", "r2": "r0", "self": "self", "out": "https://b.org/", "c9": "out"}
    landed = [(None, base + k, 302, v if "://" in v else "/" + v, None) for k, v in to.items()] + [(None, base + "c8", 200, None, "end")]
    responses = spark.createDataFrame(landed, "competitor_id string, url string, status int, location string, body string").selectExpr(
        "*", "CAST(NULL AS STRING) AS content_type", "CAST(NULL AS STRING) AS content_length", "CAST(NULL AS STRING) AS error")
    for most in (0, 1, 5):
        requests = spark.createDataFrame([(k, base + k, "a.org") for k in [*to, "c8", "none"]], "k string, url string, domain string")
        for r in resolve_redirects(requests, responses, most).collect():
            at, chain, error = r.k, [], None
            while at in to and error is None:
                if len(chain) == most:
                    error = "OUTBOUND_REDIRECT_LIMIT"
                elif "://" in to[at]:
                    error = "OUTBOUND_REFUSED"
                else:
                    at = to[at]
                    chain.append(base + at)
            error = error or (None if at == "c8" else "NOT_LANDED")
            assert (r.error_code, r.redirect_chain, r.final_url) == (error, [] if error else chain, r.url if error or not chain else chain[-1]), (most, r.k)


def test_asks_for_one_id_or_one_domain(spark):
    state = {name: empty_table(spark, name) for name in TABLES}
    made = spark.createDataFrame([(i, f"{i}.org") for i in "abcd"], "id string, domain string")
    state["competitors"] = conform(made.selectExpr("id", "id AS name", "domain", "true AS is_enabled", "false AS baseline_established",
                                                   f"{T0} AS created_at", f"{T0} AS updated_at"), "competitors")
    asks = [("a", "x.com"), ("a", "x.com"), ("b", "x.com"), ("c", "c.org"), ("c", "y.com"), ("d", "a.org")]
    changes = spark.createDataFrame([(i, "N", d, True, []) for i, d in asks], "id string, name string, domain string, is_enabled boolean, sitemap_urls array<string>")
    done = update_competitors(state, changes, F.expr(T0))
    assert {r.id: r.domain for r in done.state["competitors"].collect()} == {"a": "x.com", "b": "b.org", "c": "c.org", "d": "d.org"}
    assert done.state["competitors"].count() == 4
    assert sorted((r.id, r.code) for r in done.rejects.collect()) == [("b", CONFLICT), ("c", REPEATED), ("d", CONFLICT)]


def test_sources_of_one_moment_are_placed(spark):
    rows = spark.range(2000).selectExpr("lpad(id, 5, '0') AS id", "IF(id % 3 = 0, 'small', 'large') AS competitor_id", "'manual' AS source_type",
                                        "id % 7 <> 0 AS is_enabled", f"{T0} AS created_at")
    got = seed_order(rows).collect()
    for site in ("small", "large"):
        mine = sorted((r.id, r.seed_order) for r in got if r.competitor_id == site)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_places_follow_the_order(spark):
    got = placed(spark.range(1000).orderBy(F.col("id").desc())).collect()
    assert all(r.place == 999 - r.id for r in got)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    root = str(tmp_path / "state")

    def scan(number, site, urls):
        rows = [(f"{site}-{number}", site, f"2024-01-{number:02}", True, f"https://{site}.org/{u}", f"https://{site}.org/{u}", None, None, None) for u in urls]
        frame = spark.createDataFrame(rows, SCAN_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace("scanned_at:timestamp", "scanned_at:string"))
        return frame.withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))

    apply_batch(scan(1, "large", range(500)), 0, root)
    apply_batch(scan(2, "small", range(3)), 1, root)
    apply_batch(scan(3, "small", range(2, 5)).unionByName(scan(4, "small", range(4))), 2, root)
    sizes = [spark.read.parquet(f"{root}/batch={i}/pages").count() for i in range(3)]
    assert sizes == [500, 3, 5]
    state = read_lifecycle_state(spark, root)
    assert state["pages"].count() == 505 and state["applied_scans"].count() == 4
    small = {r.normalized_url[-1]: (r.lifecycle_status, r.missing_streak) for r in state["pages"].filter("competitor_id = 'small'").collect()}
    assert small == {"0": ("active", 0), "1": ("active", 0), "2": ("active", 0), "3": ("active", 0), "4": ("new", 1)}
    # the same batch again changes nothing
    apply_batch(scan(3, "small", range(2, 5)).unionByName(scan(4, "small", range(4))), 2, root)
    assert read_lifecycle_state(spark, root)["pages"].count() == 505


def test_all_pages_are_written_together_now_and_then(spark, tmp_path, monkeypatch):
    from sitetide.streaming import lifecycle_stream as stream

    monkeypatch.setattr(stream, "COMPACT", 2)
    root = str(tmp_path / "state")
    for number in range(5):
        rows = spark.createDataFrame([(f"s{number}", "c", True, f"https://a.org/{u}") for u in range(number, number + 3)], "scan_run_id string, competitor_id string, is_complete boolean, url string")
        apply_batch(rows.withColumns({"scanned_at": F.expr(f"timestamp_seconds({number} * 86400)"), "normalized_url": F.col("url")}), number, root)
    got = {r.normalized_url[-1]: r.lifecycle_status for r in read_lifecycle_state(spark, root)["pages"].collect()}
    assert got == {"0": "missing", "1": "missing", "2": "missing", "3": "active", "4": "active", "5": "active", "6": "new"}
    assert (tmp_path / "state" / "batch=3" / "all_pages").exists()
