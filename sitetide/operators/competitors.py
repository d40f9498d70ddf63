"""Creating, changing and removing monitored competitors; refused rows come back with a code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.text import make_id, trim_ws
from sitetide.functions.urls import normalize_domain, normalize_url
from sitetide.operators.joins import join_dimension
from sitetide.operators.merge import merge_by_key, take
from sitetide.operators.windows import first_wins
from sitetide.schemas import conform
from sitetide.session import cut_lineage

CONFLICT = "COMPETITOR_DOMAIN_CONFLICT"
INVALID_DOMAIN = "COMPETITOR_DOMAIN_INVALID"
NOT_FOUND = "COMPETITOR_NOT_FOUND"
FROZEN_DOMAIN = "COMPETITOR_DOMAIN_FROZEN"
RUNNING = "COMPETITOR_SCAN_RUNNING"
REPEATED = "COMPETITOR_ASKED_TWICE"

State = dict[str, DataFrame]


class Change(NamedTuple):
    state: State
    rejects: DataFrame


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter("deleted_at IS NULL")


def list_competitors(competitors: DataFrame, enabled_only: bool = False) -> DataFrame:
    rows = not_deleted(competitors)
    if enabled_only:
        rows = rows.filter("is_enabled")
    return rows.orderBy("name", "id").select(
        "id", "name", "domain", "is_enabled", "baseline_established", "last_scan_status", "last_scanned_at")


def count_competitors(competitors: DataFrame) -> DataFrame:
    return not_deleted(competitors).agg(F.count(F.lit(1)).alias("competitors"))


def domain_conflicts(candidates: DataFrame, competitors: DataFrame) -> DataFrame:
    """Candidates (id, domain) whose domain another active competitor has."""
    taken = not_deleted(competitors).select(F.col("domain").alias("_taken"), F.col("id").alias("_other"))
    return candidates.join(
        taken, (F.col("domain") == F.col("_taken")) & (F.col("id") != F.col("_other")), "left_semi")


def exists_any(df: DataFrame) -> DataFrame:
    """One row telling whether ``df`` has any."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def _manual_sources(rows: DataFrame, as_of: Column) -> DataFrame:
    """Source rows for (competitor_id, sitemap_urls); among equal normalized URLs the last one counts."""
    listed = (
        rows.select("competitor_id", F.posexplode("sitemap_urls").alias("position", "url"))
        .withColumn("normalized_url", normalize_url("url"))
        .filter(F.col("normalized_url").isNotNull())
    )
    last = first_wins(listed, ["competitor_id", "normalized_url"], [F.col("position").desc()])
    return conform(
        last.select(
            make_id("smp", "competitor_id", "normalized_url").alias("id"), "competitor_id", "url", "normalized_url",
            F.lit("manual").alias("source_type"), F.lit(True).alias("is_enabled"), F.lit(False).alias("is_discovered"),
            as_of.alias("created_at"), as_of.alias("updated_at")),
        "sitemap_sources",
    )


def create_competitors(state: State, new: DataFrame, as_of: Column) -> Change:
    """Add competitors (name, domain, sitemap_urls). A domain an active one has, or an earlier row asks for,
    is refused."""
    asked = new.select(
        trim_ws("name").alias("name"), F.col("domain").alias("asked_domain"),
        normalize_domain("domain").alias("domain"), "sitemap_urls")
    asked = asked.withColumn("id", make_id("cmp", "domain", as_of.cast("string")))
    invalid = asked.filter(F.col("domain").isNull()).withColumn("code", F.lit(INVALID_DOMAIN))
    valid = asked.filter(F.col("domain").isNotNull())
    taken = not_deleted(state["competitors"]).select("domain")
    free = valid.join(taken, "domain", "left_anti")
    asks = Window.partitionBy("domain").orderBy("name", "asked_domain", "sitemap_urls")
    numbered = free.withColumn("_ask", F.row_number().over(asks))
    winners = numbered.filter("_ask = 1").drop("_ask")
    losers = numbered.filter("_ask > 1").drop("_ask").unionByName(valid.join(taken, "domain", "left_semi"))
    rejects = losers.withColumn("code", F.lit(CONFLICT)).unionByName(invalid)
    rows = conform(
        winners.select(
            "id", "name", "domain", F.lit(True).alias("is_enabled"), F.lit(False).alias("baseline_established"),
            as_of.alias("created_at"), as_of.alias("updated_at")),
        "competitors",
    )
    sources = _manual_sources(winners.select(F.col("id").alias("competitor_id"), "sitemap_urls"), as_of)
    after = state | {
        "competitors": state["competitors"].unionByName(rows),
        "sitemap_sources": state["sitemap_sources"].unionByName(sources),
    }
    return Change(after, rejects.select("name", F.col("asked_domain").alias("domain"), "code"))


def update_competitors(state: State, changes: DataFrame, as_of: Column) -> Change:
    """Change name, domain, switch and sitemap list (id, name, domain, is_enabled, sitemap_urls).

    The domain is frozen once a baseline exists. A changed domain disables all sources, otherwise only the
    manual ones go; the listed URLs come back as enabled manual sources. Of several asks for one id the first in the
    order of their values counts, and equal asks are one; a new domain goes to the smallest id that asks for it and could
    have it. The others are refused.
    """
    active = not_deleted(state["competitors"]).select(
        "id", F.col("domain").alias("_domain"), F.col("baseline_established").alias("_frozen"))
    asks = changes.select(
        "id", trim_ws("name").alias("name"), normalize_domain("domain").alias("domain"), "is_enabled", "sitemap_urls").distinct()
    of_id = Window.partitionBy("id").orderBy(F.col("domain").asc_nulls_last(), "name", "is_enabled", "sitemap_urls")
    asked = asks.withColumn("_ask", F.row_number().over(of_id)).join(active, "id", "left")
    changed = F.col("domain") != F.col("_domain")
    conflicts = domain_conflicts(asked.filter(changed).select("id", "domain"), state["competitors"]).select(
        "id", F.lit(True).alias("_conflict"))
    alone = cut_lineage(asked.join(conflicts, "id", "left").withColumn(
        "code",
        F.when(F.col("_domain").isNull(), F.lit(NOT_FOUND))
        .when(F.col("_ask") > 1, F.lit(REPEATED))
        .when(F.col("domain").isNull(), F.lit(INVALID_DOMAIN))
        .when(changed & F.col("_frozen"), F.lit(FROZEN_DOMAIN))
        .when(F.col("_conflict") & changed, F.lit(CONFLICT)),
    ))
    # who asks for a domain that somebody else gets in this call, or has already
    wins = alone.filter(F.col("code").isNull() & changed).groupBy("domain").agg(F.min("id").alias("_winner"))
    checked = cut_lineage(alone.join(wins, "domain", "left").withColumn(
        "code", F.coalesce("code", F.when(changed & (F.col("id") != F.col("_winner")), F.lit(CONFLICT)))).drop("_winner", "_ask"))
    accepted = checked.filter(F.col("code").isNull()).withColumn("_changed", changed)
    competitors = merge_by_key(
        state["competitors"], accepted.select("id", "name", "domain", "is_enabled"), ["id"], insert=False,
        matched={n: take(n) for n in ("name", "domain", "is_enabled")} | {"updated_at": lambda o, n: as_of})

    touched = accepted.select(F.col("id").alias("competitor_id"), F.col("_changed"))
    sources = join_dimension(state["sitemap_sources"], touched, ["competitor_id"], ["id"], "left")
    off = F.coalesce(F.col("_changed") | (F.col("_changed").isNotNull() & (F.col("source_type") == "manual")), F.lit(False))
    sources = sources.withColumns(
        {
            "is_enabled": F.when(off, F.lit(False)).otherwise(F.col("is_enabled")),
            "updated_at": F.when(off, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*state["sitemap_sources"].columns)
    listed = _manual_sources(accepted.select(F.col("id").alias("competitor_id"), "sitemap_urls"), as_of)
    back = {n: take(n) for n in ("url", "source_type", "is_enabled", "is_discovered", "parent_source_id",
                                 "last_error", "updated_at")}
    sources = merge_by_key(sources, listed, ["competitor_id", "normalized_url"], matched=back)
    rejects = checked.filter(F.col("code").isNotNull()).select("id", "domain", "code")
    return Change(state | {"competitors": competitors, "sitemap_sources": sources}, rejects)


def soft_delete(state: State, ids: DataFrame, as_of: Column) -> Change:
    """Mark competitors (id) and their pages deleted and switch their sources off; refused while scanning."""
    active = not_deleted(state["competitors"]).select("id", F.lit(True).alias("_active"))
    running = state["scan_runs"].filter(F.col("status") == "running").select(
        F.col("competitor_id").alias("id"), F.lit(True).alias("_running")).distinct()
    checked = ids.select("id").distinct().join(active, "id", "left").join(running, "id", "left").withColumn(
        "code", F.when(F.col("_active").isNull(), F.lit(NOT_FOUND)).when(F.col("_running"), F.lit(RUNNING)))
    gone = checked.filter(F.col("code").isNull()).select("id")
    competitors = merge_by_key(
        state["competitors"], gone, ["id"], insert=False,
        matched={"is_enabled": lambda o, n: F.lit(False), "deleted_at": lambda o, n: as_of,
                 "updated_at": lambda o, n: as_of})
    marks = gone.select(F.col("id").alias("competitor_id"), F.lit(True).alias("_gone"))

    def marked(name: str, hit: Column, values: dict[str, Column]) -> DataFrame:
        rows = join_dimension(state[name], marks, ["competitor_id"], ["id"], "left")
        return rows.withColumns(
            {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*state[name].columns)

    is_gone = F.coalesce(F.col("_gone"), F.lit(False))
    after = state | {
        "competitors": competitors,
        "sitemap_sources": marked("sitemap_sources", is_gone, {"is_enabled": F.lit(False), "updated_at": as_of}),
        "pages": marked("pages", is_gone & F.col("deleted_at").isNull(), {"deleted_at": as_of, "updated_at": as_of}),
    }
    return Change(after, checked.filter(F.col("code").isNotNull()).select("id", "code"))


def competitor_config(competitors: DataFrame, sources: DataFrame) -> DataFrame:
    """Active competitors with their enabled manual sitemap URLs in creation order (at most ten are accepted)."""
    manual = sources.filter(F.col("is_enabled") & (F.col("source_type") == "manual"))
    listed = manual.groupBy(F.col("competitor_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("created_at", "url"))), lambda s: s["url"]).alias("_urls"))
    return (
        not_deleted(competitors).select("id", "name", "domain", "is_enabled", "baseline_established")
        .join(listed, "id", "left")
        .withColumn("manual_sitemap_urls", F.coalesce("_urls", F.array().cast("array<string>")))
        .drop("_urls")
    )
