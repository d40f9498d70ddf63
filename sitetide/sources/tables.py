"""State-table and landed-response sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.functions.text import as_col
from sitetide.schemas import LANDED, TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One state table with its declared schema (no inference pass over the files)."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def read_state(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Plain tables, one folder each; ``state_store`` reads and writes versioned ones."""
    return {name: read_table(spark, name, f"{root}/{name}", fmt) for name in TABLES}


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed responses: Parquet/ORC/JSON with the landed schema, or ``text`` for one body per file."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.lit(None).cast("string").alias("competitor_id"),
            F.input_file_name().alias("url"),
            F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("location"),
            F.lit(None).cast("string").alias("content_type"),
            F.lit(None).cast("string").alias("content_length"),
            F.col("value").alias("body"),
            F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("timestamp").alias("landed_at"),
        )
    return spark.read.schema(LANDED["responses"]).format(fmt).load(path)


def too_large(body: Column | str, declared: Column | str, max_bytes: int | None) -> Column:
    """True when the declared length, or else the actual byte count, passes the limit; never without one."""
    if max_bytes is None:
        return F.lit(False)
    declared_bytes = F.trim(as_col(declared)).try_cast("double")
    return (F.coalesce(declared_bytes > max_bytes, F.lit(False))
            | F.coalesce(F.octet_length(as_col(body)) > max_bytes, F.lit(False)))


def size_error(max_bytes: int | None) -> str:
    return f"Response exceeds {max_bytes} bytes"


def body_limit(df: DataFrame, max_bytes: int) -> DataFrame:
    """Set ``error`` on oversized responses and drop their body; other rows pass unchanged."""
    over = too_large("body", "content_length", max_bytes)
    return df.withColumns(
        {
            "error": F.when(F.col("error").isNull() & over, F.lit(size_error(max_bytes))).otherwise(F.col("error")),
            "body": F.when(~over, F.col("body")),
        }
    )
