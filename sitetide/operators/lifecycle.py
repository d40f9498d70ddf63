"""Page lifecycle: baseline, transitions of one scan, and replay of a whole scan history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.functions.jsons import safe_json
from sitetide.functions.text import make_id
from sitetide.functions.urls import safe_normalize
from sitetide.operators import diff as D
from sitetide.operators.joins import join_dimension, join_hot
from sitetide.operators.merge import insert_or_ignore, merge_by_key, take
from sitetide.schemas import TABLES, conform
from sitetide.session import cut_lineage

State = dict[str, DataFrame]


def page_id(competitor_id: Column | str = "competitor_id", normalized_url: Column | str = "normalized_url") -> Column:
    return make_id("page", competitor_id, normalized_url)


def new_events(
    rows: DataFrame, page: Column, scan: Column, kind: Column, as_of: Column, value: Column | None = None
) -> DataFrame:
    """Rows of the event log; the id follows from page, scan and kind."""
    return conform(
        rows.select(
            make_id("evt", page, F.coalesce(scan, F.lit("")), kind, as_of.cast("string")).alias("id"),
            page.alias("page_id"),
            scan.alias("scan_run_id"),
            kind.alias("event_type"),
            F.lit(None).cast("string").alias("old_value_json"),
            (value if value is not None else F.lit(None).cast("string")).alias("new_value_json"),
            as_of.alias("detected_at"),
            as_of.alias("created_at"),
        ),
        "page_events",
    )


def append_events(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def without_event(pages: DataFrame, events: DataFrame, event_type: str) -> DataFrame:
    """Pages (with ``page_id``) that have no event of that type yet."""
    seen = events.filter(F.col("event_type") == event_type).select("page_id")
    return pages.join(seen, "page_id", "left_anti")


def new_page_rows(rows: DataFrame, status: str, as_of: Column) -> DataFrame:
    """Page rows for first sightings: competitor_id, normalized_url, url, lastmod, scan_run_id."""
    return conform(
        rows.select(
            page_id().alias("id"),
            "competitor_id",
            F.col("url").alias("original_url"),
            "normalized_url",
            F.col("url").alias("current_url"),
            F.lit(status).alias("lifecycle_status"),
            F.lit(0).alias("missing_streak"),
            as_of.alias("first_seen_at"),
            as_of.alias("last_seen_at"),
            F.col("lastmod").alias("sitemap_lastmod"),
            F.col("scan_run_id").alias("first_scan_run_id"),
            F.col("scan_run_id").alias("last_scan_run_id"),
            as_of.alias("created_at"),
            as_of.alias("updated_at"),
        ),
        "pages",
    )


def attach_source_id(
    rows: DataFrame, sources: DataFrame, url: str = "source_url", explicit: str | None = None, spread: str = "normalized_url"
) -> DataFrame:
    """``sitemap_source_id`` by normalized source URL; an explicit id goes first.

    Each source URL is normalized once, however many rows name it; rows of a source with very many are split by ``spread``.
    """
    known = sources.select("competitor_id", F.col("normalized_url").alias("_source_key"), F.col("id").alias("_found"))
    counts = cut_lineage(rows.filter(F.col(url).isNotNull() & F.col("competitor_id").isNotNull()).groupBy("competitor_id", url).agg(
        F.count(F.lit(1)).alias("n")))
    named = counts.withColumn("_source_key", safe_normalize(url)).join(known, ["competitor_id", "_source_key"]).select("competitor_id", url, "_found")
    joined = join_hot(rows, named, ["competitor_id", url], [spread], "left", counts=counts)
    found = F.coalesce(F.col(explicit), F.col("_found")) if explicit else F.col("_found")
    return joined.withColumn("sitemap_source_id", found).drop("_found")


def upsert_links(links: DataFrame, sightings: DataFrame, as_of: Column) -> DataFrame:
    """Page-sitemap links after sightings (page_id, sitemap_source_id, lastmod): first_seen stays."""
    changes = sightings.filter(F.col("sitemap_source_id").isNotNull()).groupBy("page_id", "sitemap_source_id").agg(
        F.max("lastmod").alias("sitemap_lastmod"))
    changes = changes.select(
        "page_id", "sitemap_source_id", as_of.alias("first_seen_at"), as_of.alias("last_seen_at"),
        F.lit(True).alias("is_current"), "sitemap_lastmod")
    moved = {name: take(name) for name in ("last_seen_at", "is_current", "sitemap_lastmod")}
    return merge_by_key(links, changes, ["page_id", "sitemap_source_id"], matched=moved)


def listed_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (competitor_id, normalized_url, ...) with the ``page_id`` they have: that of the known pages, else the one they get.

    A URL that is listed in two spellings stays two rows, whether its page is known or new.
    """
    known = pages.select(*D.KEY, F.col("id").alias("_known"))
    return rows.dropna(subset=D.KEY).join(known, D.KEY, "left").withColumn("page_id", F.coalesce("_known", page_id())).drop("_known")


def establish_baseline(state: State, entries: DataFrame, scans: DataFrame, as_of: Column) -> State:
    """First complete scan of a competitor: its entries become baseline pages.

    entries: competitor_id, normalized_url, url, lastmod, source_url; scans: competitor_id, scan_run_id.
    Existing pages and existing ``baseline_added`` events are left alone, so a retry changes nothing.
    """
    rows = join_dimension(
        entries, scans.select("competitor_id", "scan_run_id"), ["competitor_id"], ["normalized_url"])
    pages = insert_or_ignore(state["pages"], new_page_rows(rows, "baseline", as_of), D.KEY)
    listed = cut_lineage(listed_pages(rows.select(*D.KEY, "scan_run_id", "lastmod", "source_url"), state["pages"]))
    missing = without_event(listed, state["page_events"], "baseline_added")
    events = new_events(missing, F.col("page_id"), F.col("scan_run_id"), F.lit("baseline_added"), as_of)
    links = upsert_links(
        state["page_sitemap_links"], attach_source_id(listed, state["sitemap_sources"]), as_of)
    done = scans.select(F.col("competitor_id").alias("id")).distinct()
    competitors = merge_by_key(
        state["competitors"], done, ["id"], insert=False,
        matched={"baseline_established": lambda o, n: F.lit(True), "updated_at": lambda o, n: as_of})
    return state | {
        "pages": pages,
        "page_events": append_events(state["page_events"], events),
        "page_sitemap_links": links,
        "competitors": competitors,
    }


EVENT_OF_CHANGE = {
    D.NEW: "discovered",
    D.CONFIRMED_MISSING: "missing_confirmed",
    D.REAPPEARED: "reappeared",
}


def transition(classified: DataFrame, as_of: Column) -> DataFrame:
    """Page rows after one scan, straight from the classified join (no second join on the page id)."""
    kind, page, entry = F.col("change_type"), F.col("page"), F.col("entry")
    run = F.col("scan.scan_run_id")
    sighted = kind.isin(D.PRESENT, D.REAPPEARED)
    absent = kind.isin(D.FIRST_MISSING, D.CONFIRMED_MISSING)
    fresh = kind == D.NEW
    status = (
        F.when(fresh, F.lit("new"))
        .when(kind == D.PRESENT, F.lit("active"))
        .when(kind == D.REAPPEARED, F.lit("reappeared"))
        .when(kind == D.CONFIRMED_MISSING, F.lit("missing"))
        .otherwise(page["lifecycle_status"])
    )
    streak = (
        F.when(fresh | sighted, F.lit(0)).when(absent, page["missing_streak"] + 1).otherwise(page["missing_streak"])
    )
    touched = F.coalesce(kind.isNotNull(), F.lit(False))
    seen = F.coalesce(fresh | sighted, F.lit(False))
    values = {
        "id": F.coalesce(page["id"], page_id()),
        "original_url": F.coalesce(page["original_url"], entry["url"]),
        "current_url": F.when(seen, entry["url"]).otherwise(page["current_url"]),
        "lifecycle_status": status,
        "missing_streak": streak,
        "first_seen_at": F.coalesce(page["first_seen_at"], as_of),
        "last_seen_at": F.when(seen, as_of).otherwise(page["last_seen_at"]),
        "sitemap_lastmod": F.when(seen, entry["lastmod"]).otherwise(page["sitemap_lastmod"]),
        "first_scan_run_id": F.when(page.isNull(), run).otherwise(page["first_scan_run_id"]),
        "last_scan_run_id": F.when(touched, run).otherwise(page["last_scan_run_id"]),
        "created_at": F.coalesce(page["created_at"], as_of),
        "updated_at": F.when(touched, as_of).otherwise(page["updated_at"]),
        "deleted_at": page["deleted_at"],
    }
    rows = classified.filter(page.isNotNull() | fresh)
    columns = [f.name for f in TABLES["pages"].fields]
    return conform(rows.select(*[values.get(c, F.col(c)).alias(c) for c in columns]), "pages")


def diff_events(classified: DataFrame, as_of: Column) -> DataFrame:
    kind = F.col("change_type")
    event = F.create_map(*[F.lit(x) for pair in EVENT_OF_CHANGE.items() for x in pair])[kind]
    rows = classified.filter(kind.isin(list(EVENT_OF_CHANGE)))
    value = F.when(F.col("entry").isNotNull(), safe_json(url=F.col("entry.url")))
    return new_events(
        rows, F.coalesce(F.col("page.id"), page_id()), F.col("scan.scan_run_id"), event, as_of, value)


def apply_diff(state: State, classified: DataFrame, as_of: Column) -> State:
    """State after one scan per competitor. New pages also get a review row and a pending SEO row.

    ``classified`` feeds several tables; checkpoint it first when its inputs are expensive.
    """
    fresh = classified.filter(F.col("change_type") == D.NEW).select(
        *D.KEY, page_id().alias("page_id"), F.col("entry.lastmod").alias("lastmod"),
        F.col("entry.source_url").alias("source_url"))
    reviews = conform(
        fresh.select("page_id", F.lit("unreviewed").alias("review_status"), F.lit(False).alias("is_viewed"),
                     F.lit(False).alias("is_worth_following"), as_of.alias("created_at"), as_of.alias("updated_at")),
        "page_review")
    seo = conform(
        fresh.select("page_id", F.lit("pending").alias("fetch_status"), as_of.alias("updated_at")), "page_seo_data")
    return state | {
        "pages": transition(classified, as_of),
        "page_events": append_events(state["page_events"], diff_events(classified, as_of)),
        "page_review": insert_or_ignore(state["page_review"], reviews, ["page_id"]),
        "page_seo_data": insert_or_ignore(state["page_seo_data"], seo, ["page_id"]),
        "page_sitemap_links": upsert_links(
            state["page_sitemap_links"], attach_source_id(fresh, state["sitemap_sources"]), as_of),
    }


class Replay(NamedTuple):
    state: DataFrame
    events: DataFrame


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, bucket: Column, name: str) -> DataFrame:
    """Running count of ``flag`` per key in ``order``, split by ``bucket`` (monotonic in ``order``).

    Buckets are counted in parallel and only their totals are accumulated, so one long history does
    not end up in one task.
    """
    parts = df.withColumn("_bucket", bucket).withColumn("_flag", flag.cast("bigint"))
    totals = parts.groupBy(*keys, "_bucket").agg(F.sum("_flag").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.withColumn("_inside", F.sum("_flag").over(inside)).join(offsets, [*keys, "_bucket"])
    return counted.withColumn(name, F.col("_inside") + F.col("_offset")).drop(
        "_bucket", "_flag", "_inside", "_offset")


def lifecycle_replay(scans: DataFrame, sightings: DataFrame, bucket: Column | None = None) -> Replay:
    """Final page state and all lifecycle events of a scan history.

    scans: competitor_id, scan_no (ordered), is_complete. sightings: competitor_id, url, scan_no.
    Works on sightings only: every scan knows how many complete scans came up to it, so the absences
    between two sightings are a difference of two counts and absent (URL, scan) pairs never become rows. A
    (competitor, URL) window holds at most one row per scan; scans that list very many URLs are salted.
    """
    bucket = F.floor(F.col("scan_no") / 512) if bucket is None else bucket
    counted = running_count(
        scans.select("competitor_id", "scan_no", "is_complete"), ["competitor_id"], "scan_no",
        F.col("is_complete"), bucket, "done")
    totals = scans.groupBy("competitor_id").agg(F.count_if("is_complete").alias("all_done"))

    history = Window.partitionBy("competitor_id", "url").orderBy("scan_no")
    so_far = history.rowsBetween(Window.unboundedPreceding, 0)
    distinct = sightings.select("competitor_id", "url", "scan_no").distinct()
    seen = (
        join_dimension(distinct, counted, ["competitor_id", "scan_no"], ["url"])
        .withColumn("_started", F.max("is_complete").over(so_far))
        .filter("_started")
        .withColumns(
            {
                "_previous": F.lag("done").over(history),
                "_next_scan": F.lead("scan_no").over(history),
                "_next_gap": F.lead(F.col("done") - F.col("is_complete").cast("bigint")).over(history)
                - F.col("done"),
                "_first_scan": F.first("scan_no").over(so_far),
            }
        )
    )
    seen = join_dimension(seen, totals, ["competitor_id"], ["url"])
    absences = F.col("done") - F.col("is_complete").cast("bigint") - F.col("_previous")
    status = (
        F.when(F.col("_previous").isNull() & (F.col("done") == 1), F.lit("baseline"))
        .when(F.col("_previous").isNull(), F.lit("new"))
        .when(absences >= D.CONFIRM_AFTER, F.lit("reappeared"))
        .otherwise(F.lit("active"))
    )
    seen = seen.withColumn("_status", status)

    tail = F.col("all_done") - F.col("done")
    state = seen.filter(F.col("_next_scan").isNull()).select(
        "competitor_id",
        "url",
        F.when(tail >= D.CONFIRM_AFTER, F.lit("missing")).otherwise(F.col("_status")).alias("lifecycle_status"),
        F.least(tail, F.lit(D.CONFIRM_AFTER)).cast("bigint").alias("missing_streak"),
        F.col("_first_scan").alias("first_seen_scan"),
        F.col("scan_no").alias("last_seen_scan"),
    )

    event_names = {"baseline": "baseline_added", "new": "discovered", "reappeared": "reappeared"}
    names = F.create_map(*[F.lit(x) for pair in event_names.items() for x in pair])
    sighted = seen.filter(F.col("_status") != "active").select(
        "competitor_id", "url", "scan_no", names[F.col("_status")].alias("event_type"))
    gap = F.coalesce("_next_gap", tail)
    confirmed = (
        seen.filter(gap >= D.CONFIRM_AFTER)
        .select("competitor_id", "url", (F.col("done") + D.CONFIRM_AFTER).alias("done"))
    )
    complete = counted.filter("is_complete").select("competitor_id", "done", "scan_no")
    confirmed = join_dimension(confirmed, complete, ["competitor_id", "done"], ["url"]).select(
        "competitor_id", "url", "scan_no", F.lit("missing_confirmed").alias("event_type"))
    return Replay(state, sighted.unionByName(confirmed))
