"""A global shuffle into shards that fits any size: scatter, then shuffle bucket by bucket.

Law: ``rows``. The shards' row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.llm.common import LOOKUP_ROWS, lookup, running_offsets, staged, text_or_empty

BUCKET, RANK = "_bucket", "_rank"
#: Equal rows that stay together in a bucket.
COPIES = 64


def record_size(column: str = "text") -> Column:
    """UTF-8 bytes of the text and 16 for the rest of the record."""
    return (F.octet_length(text_or_empty(column)) + 16).cast("long")


def _plain(columns: list[str], kinds: dict[str, T.DataType]) -> Column:
    """The row as a struct that can be hashed and ordered: maps as their entries in order."""
    return F.struct(*[(F.array_sort(F.map_entries(f"`{c}`")) if isinstance(kinds[c], T.MapType) else F.col(f"`{c}`")).alias(f"c{i}")
                      for i, c in enumerate(columns)])


def shuffle_buckets(rows: DataFrame, seed: int, bucket_bytes: int, text: str = "text") -> tuple[DataFrame, int]:
    """The rows with the bucket they were scattered to and their place in its shuffled order; the number of buckets.

    First pass: a seeded hash of the row's content and, for a row that occurs very often, the number of its copy deals the rows
    out, so buckets have about ``bucket_bytes`` bytes (a single larger record makes its bucket as large). Equal rows can stand
    for one another, so those copies are counted and made anew from one of them. Second pass: each bucket is one array, put in
    order and then shuffled (Fisher-Yates) with the seed. Nothing depends on how the input is split into files or tasks.
    The result is staged: each bucket comes whole from one task, so a repeated task can't mix two orders.
    """
    columns, kinds = rows.columns, {f.name: f.dataType for f in rows.schema}
    total = rows.select(record_size(text).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    n_buckets = max(1, math.ceil((total[0] or 0) / bucket_bytes))
    named = rows.select(_plain(columns, kinds).alias("_row")).select(
        F.xxhash64(F.lit(seed), "_row").alias("_a"), F.xxhash64(F.lit(~seed), "_row").alias("_b"), "_row")
    most = max(COPIES, -(-total[1] // LOOKUP_ROWS))  # so that at most LOOKUP_ROWS rows occur more often
    often = staged(named.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most))
    single = named.join(F.broadcast(often.drop("_n")), ["_a", "_b"], "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    kept = named.join(F.broadcast(often), ["_a", "_b"]).groupBy("_a", "_b", "_n").agg(F.first("_row").alias("_row"))
    made = kept.select("_a", "_b", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    scattered = single.unionByName(made).withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(seed), "_a", "_b", "_copy"), F.lit(n_buckets)))
    order = F.sort_array(F.collect_list(F.struct("_a", "_b", "_copy", "_row")))
    arrays = scattered.repartition(n_buckets, BUCKET).groupBy(BUCKET).agg(order.alias("_rows")).sortWithinPartitions(BUCKET)
    shuffled = arrays.select(BUCKET, F.posexplode(F.shuffle("_rows", F.lit(seed))).alias(RANK, "_item"))
    back = {c: F.col(f"_item._row.c{i}") for i, c in enumerate(columns)}
    plain = shuffled.select(*[(F.map_from_entries(x) if isinstance(kinds[c], T.MapType) else x).alias(c) for c, x in back.items()], BUCKET, RANK)
    return staged(plain), n_buckets


def shard(rows: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """All columns of the rows, shard (0 to n_shards - 1) and slot (place in the shard, from 0 without gaps).

    Row number p of the global shuffle goes to shard p mod n, slot p div n. Null or empty texts, null ids and repeated rows
    are records like others; columns named shard or slot are replaced; an empty table gives an empty result. Bucket
    offsets are at most one short row a bucket; they are broadcast up to a checked number and joined beyond it.
    """
    rows = rows.drop("shard", "slot", BUCKET, RANK)
    shuffled, n_buckets = shuffle_buckets(rows, seed, bucket_bytes, text)
    counts = shuffled.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(counts, BUCKET, "_n", "_offset")
    place = F.col("_offset") + F.col(RANK)
    return shuffled.join(lookup(offsets, n_buckets), BUCKET).withColumns({
        "shard": (place % n_shards).cast("int"), "slot": F.floor(place / n_shards).cast("long"),
    }).drop(BUCKET, RANK, "_offset")


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write the shards, one folder each; a large shard spans several files, in the order of its slots."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
