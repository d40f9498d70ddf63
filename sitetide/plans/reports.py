"""Dashboard, list, export and detail over the state tables."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from sitetide.functions.times import moment
from sitetide.operators import pages as P
from sitetide.operators.competitors import list_competitors
from sitetide.operators.metrics import metrics_review, metrics_status
from sitetide.operators.scans import recent_scans
from sitetide.sources.export import export_pages as write_export

State = dict[str, DataFrame]


class PageList(NamedTuple):
    items: DataFrame
    total: DataFrame


def dashboard(state: State, as_of: datetime | str | Column) -> dict[str, DataFrame]:
    now = moment(as_of)
    return {
        "competitors": list_competitors(state["competitors"]),
        "new_pages": metrics_status(state["pages"], state["competitors"], now),
        "reviews": metrics_review(state["page_review"], state["pages"], state["competitors"]),
        "recent_scans": recent_scans(state["scan_runs"], state["competitors"], active_only=True),
    }


def listed_pages(state: State, **filters) -> DataFrame:
    rows = P.page_list(
        state["pages"], state["competitors"], state["page_seo_data"], state["page_review"], state["page_analyses"],
        state["page_events"])
    return P.filter_pages(rows, **filters)


def list_pages(state: State, page: int = 1, page_size: int = P.DEFAULT_PAGE_SIZE, after: P.Cursor | None = None, **filters) -> PageList:
    """One page of the filtered list, by its number or behind the cursor of the page before it, and the total of the whole list."""
    rows = listed_pages(state, **filters)
    items = P.paginate(rows, page, page_size) if after is None else P.next_page(rows, after, page_size)
    return PageList(items, P.count_pages(rows))


def export_pages(state: State, path: str, limit: int | None = None, **filters) -> None:
    write_export(listed_pages(state, **filters), path, limit)


def page_detail(state: State, page_id: str) -> tuple[DataFrame, DataFrame]:
    return P.page_detail(state, page_id)
