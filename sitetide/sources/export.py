"""CSV export of the page list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.functions.text import csv_cell
from sitetide.functions.times import iso_utc
from sitetide.operators.pages import list_order
from sitetide.operators.windows import placed

# Fixed value: the rows that the reporting page exports.
EXPORT_LIMIT = 5_000
BOM = chr(0xFEFF)

# Header cells and the list column behind each.
EXPORT_COLUMNS = {
    "First Seen": "first_seen_at",
    "Competitor": "competitor_name",
    "URL": "url",
    "Title": "title",
    "Lifecycle Status": "lifecycle_status",
    "Fetch Status": "fetch_status",
    "Analysis Status": "analysis_status",
    "Page Type": "page_type",
    "Primary Keyword (Inferred)": "primary_keyword",
    "Search Intent": "search_intent",
    "Review Status": "review_status",
    "Worth Following": "is_worth_following",
}


def _cell(rows: DataFrame, name: str) -> Column:
    kind = rows.schema[name].dataType.typeName()
    if kind == "timestamp":
        text = iso_utc(name)
    elif kind == "boolean":
        text = F.when(F.col(name), F.lit("yes")).otherwise(F.lit("no"))
    else:
        text = F.col(name).cast("string")
    return csv_cell(F.coalesce(text, F.lit("")))


def csv_line(rows: DataFrame) -> Column:
    return F.concat_ws(",", *[_cell(rows, name) for name in EXPORT_COLUMNS.values()])


def csv_header() -> str:
    return ",".join(f'"{title}"' for title in EXPORT_COLUMNS)


def _ordered_lines(rows: DataFrame, limit: int | None) -> DataFrame:
    """The lines in their order: the header is a row of the one sort that orders the pages."""
    listed = rows if limit is None else rows.orderBy(*list_order()).limit(limit)
    none = F.lit(None)
    header = rows.sparkSession.range(1).select(
        F.lit(True).alias("_head"), none.cast(rows.schema["first_seen_at"].dataType).alias("first_seen_at"), none.cast("string").alias("id"),
        F.lit(BOM + csv_header()).alias("line"))
    body = listed.select(F.lit(False).alias("_head"), "first_seen_at", "id", csv_line(rows).alias("line"))
    return header.unionByName(body).orderBy(F.col("_head").desc(), *list_order())


def export_lines(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(line_no, line): the BOM-marked header, then the pages in list order; the newest ``limit`` if one is given."""
    return placed(_ordered_lines(rows, limit), "line_no").select("line_no", "line")


def export_pages(rows: DataFrame, path: str, limit: int | None = None) -> None:
    """Write CSV text: UTF-8 with BOM, CRLF line breaks, every cell quoted.

    The lines are ordered once, by ranges; each range is a file, and the files' names follow the order. The first one
    begins with the header. A file counts when Spark's committer has moved it into the folder.
    """
    _ordered_lines(rows, limit).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of a written export: the bytes of its files, whose order is that of their names."""
    return spark.read.format("binaryFile").load(f"{path}/part-*").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
