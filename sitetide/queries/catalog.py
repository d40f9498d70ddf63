"""All registered queries."""

from sitetide.queries import (  # noqa: F401
    analysis_queries,
    html_queries,
    lifecycle_queries,
    page_queries,
    scan_queries,
    sitemap_queries,
    state_queries,
    url_queries,
)
from sitetide.queries.registry import ORACLES, QUERIES  # noqa: F401
