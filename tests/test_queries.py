"""Registered queries against their SQL on the smallest data. ``QUERIES=all`` runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from sitetide.queries import catalog

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUICK = [
    "normalize_url", "outbound_guard", "resolve_url", "seo_page", "fetch_upsert", "redirect_chain", "scan_diff", "apply_diff",
    "baseline_events", "replay_events", "sitemap_visits", "root_candidates", "page_list", "page_detail", "csv_export",
    "metrics_review", "soft_delete", "create_competitors", "quality_rules", "analysis_validate", "sitemap_expand", "sitemap_depth_limit",
    "run_scan_sources", "stream_lifecycle", "state_written", "csv_written", "update_competitors", "page_list_next", "competitor_list",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("QUERIES") == "all" else QUICK


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    result = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str(tuple(row[i] for i in order)) for row in result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
