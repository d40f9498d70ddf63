"""First-row and top-k selections.

All use ``row_number() <= k``, for which Spark limits each group before the shuffle, so a group that
holds a large share of all rows reaches the reducer as at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitetide.session import cut_lineage


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """An ordered frame with each row's place in its order, from 0: partition sizes are summed up, no task sees all rows."""
    numbered = cut_lineage(ordered.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_in") - F.col("_low")).drop(
        "_part", "_in", "_low", "_offset")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_rows(df, keys, order, 1)


def first_entry(entries: DataFrame) -> DataFrame:
    """First occurrence of every normalized URL in traversal order."""
    return first_wins(entries, ["competitor_id", "normalized_url"], [F.col("path").asc(), F.col("position").asc()])


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Per page: successful ones first, then the most recent; ties go to the larger id."""
    order = [
        (F.col("status") != "success").asc(),
        F.coalesce("analyzed_at", "created_at").desc_nulls_last(),
        F.col("id").desc(),
    ]
    return first_wins(analyses, ["page_id"], order)


def timeline(events: DataFrame, n: int = 100) -> DataFrame:
    """The latest ``n`` events of every page."""
    return top_rows(events, ["page_id"], [F.col("detected_at").desc(), F.col("id").desc()], n)
