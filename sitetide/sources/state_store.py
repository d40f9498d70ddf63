"""State tables that are written back: laid out by a hash of the key, only touched parts rewritten, versions swapped whole.

    root/tables/<table>/version=<n>/bucket=<b>/part-*.parquet      rows whose key falls in the bucket, as version n wrote them
    root/versions/<n>.json                                         which version of each bucket counts

A version is a small file that names, for each table and bucket, the version that wrote it last. It appears by one rename at
the end, so a reader sees a whole state, and a writer that breaks off leaves nothing that counts. Files are never changed.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.schemas import PRIMARY_KEYS, TABLES, conform, empty_table

BUCKETS = 64


class Written(NamedTuple):
    """The new version, and the buckets of each table that it rewrote."""

    version: int
    buckets: dict[str, list[int]]


class StaleVersionError(RuntimeError):
    """Another writer finished the version that this one wanted to write."""


def bucket_of(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PRIMARY_KEYS[table]), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The newest version and what it names; (0, {}) before the first."""
    fs, folder = _files(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{root}/versions/{max(numbers)}.json", wholetext=True).first()["value"]
    return max(numbers), json.loads(text)


def _swap(spark: SparkSession, root: str, version: int, named: dict) -> None:
    fs, target = _files(spark, f"{root}/versions/{version}.json")
    _, draft = _files(spark, f"{root}/versions/_draft-{version}-{spark._jvm.java.util.UUID.randomUUID()}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise StaleVersionError(f"version {version} is there already")


def state_version(spark: SparkSession, root: str) -> int:
    return _current(spark, root)[0]


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version; empty ones where nothing was written."""
    _, named = _current(spark, root)
    return {name: _stored(spark, root, named, name) for name in TABLES}


def _stored(spark: SparkSession, root: str, named: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
    """A table, or only some of its buckets: other files are not opened."""
    places = named.get(name, {}).get("written", {})
    wanted = [f"{root}/tables/{name}/version={v}/bucket={b}" for b, v in places.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(TABLES[name]).parquet(*wanted) if wanted else empty_table(spark, name)


def _write(rows: DataFrame, root: str, name: str, version: int, buckets: int) -> list[int]:
    """Write the rows by bucket, each bucket by one task; the buckets that have rows."""
    path = f"{root}/tables/{name}/version={version}"
    placed = conform(rows, name).withColumn("bucket", bucket_of(name, buckets))
    placed.repartition("bucket").sortWithinPartitions("bucket", *PRIMARY_KEYS[name]).write.mode("overwrite").partitionBy("bucket").parquet(path)
    fs, folder = _files(rows.sparkSession, path)
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket="))


def write_state(state: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> Written:
    """Write whole tables as the next version; tables that are not given keep theirs."""
    spark = next(iter(state.values())).sparkSession
    version, named = _current(spark, root)
    written = {}
    for name, rows in state.items():
        written[name] = _write(rows, root, name, version + 1, buckets)
        named[name] = {"buckets": buckets, "written": {str(b): version + 1 for b in written[name]}}
    _swap(spark, root, version + 1, named)
    return Written(version + 1, written)


def write_changes(changes: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> Written:
    """The next version with changed and new rows, whole rows that replace those of their key (at most one row a key).

    Only the buckets that the changed keys fall in are read and written again. The list of these is all that the driver
    sees: at most one number a bucket.
    """
    spark = next(iter(changes.values())).sparkSession
    version, named = _current(spark, root)
    written = {}
    for name, rows in changes.items():
        layout = named.get(name, {"buckets": buckets, "written": {}})
        n, keys = layout["buckets"], PRIMARY_KEYS[name]
        touched = [r["b"] for r in rows.select(bucket_of(name, n).alias("b")).distinct().collect()]
        if not touched:
            written[name] = []
            continue
        kept = _stored(spark, root, named, name, touched).join(rows.select(*keys), keys, "left_anti")
        written[name] = _write(kept.select(*TABLES[name].names).unionByName(conform(rows, name)), root, name, version + 1, n)
        named[name] = layout | {"written": layout["written"] | {str(b): version + 1 for b in written[name]}}
    _swap(spark, root, version + 1, named)
    return Written(version + 1, written)
