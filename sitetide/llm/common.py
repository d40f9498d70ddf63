"""What several corpus operators share: staged tables, offsets of buckets, vectorised words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitetide.session import shared_dir

#: Regular expression of one run of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"
#: Most rows of a lookup table that are sent to all workers at once (16 bytes each).
LOOKUP_ROWS = 1 << 20


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again.

    Cuts the lineage: a lost executor repeats one task, not what came before. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    goes_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def goes_at_end(spark: SparkSession, path: str) -> None:
    """The written path is deleted when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete what was written to a scratch path and is read no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def running_offsets(counts: DataFrame, key: str, count: str, offset: str, by: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """(by, key, offset): the sum of ``count`` over all smaller keys of the same ``by``; whole-number keys without repeats.

    Two levels: sums of key blocks first, so that no task orders more than ``block`` keys or one row per block.
    """
    part = F.floor(F.col(key) / block)
    blocks = counts.groupBy(*by, part.alias("_block")).agg(F.sum(count).alias("_sum"))
    over = Window.partitionBy(*by) if by else Window
    before = F.coalesce(F.sum("_sum").over(over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy(*by, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_block", part).withColumn("_inner", F.coalesce(F.sum(count).over(within), F.lit(0)))
    return inner.join(blocks.select(*by, "_block", before.alias("_before")), [*by, "_block"]).select(
        *by, key, (F.col("_before") + F.col("_inner")).cast("long").alias(offset))


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """A side for a join, sent to all workers where its known number of rows is within the bound."""
    return F.broadcast(df) if rows <= LOOKUP_ROWS else df


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``; after each batch and at the end, memory that Arrow holds unused goes back to the
    system. A worker process outlives its task, and what it holds counts beside all later stages of its executor."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return tidy


# --- words of whole Arrow batches ---------------------------------------------------------------------

#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: Which bits of eight bytes belong to a word that has so many of them.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first) : byte bounds of all words, and the number of words before each text (one more at the end).

    ``between`` says of each of the 256 bytes whether it parts words."""
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = between[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)  # a text begins here
    cut[starts[:-1]] = True
    cut[len(raw)] = True
    inside = ~gap[1:]
    before = ~gap[:-1]
    begin = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z in lower case, alike in every process.

    A word's bytes are taken eight at a time; each eight, with their place, are mixed before they are added up."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    pieces = -(-size // 8)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(begin, pieces) + 8 * place
    padded = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))[at] & _KEPT[np.minimum(np.repeat(end, pieces) - at, 8)]
    spread = mix(eight + mix((place + 1).astype(np.uint64) * _PLACE))
    return mix(np.add.reduceat(spread, first) + size.astype(np.uint64))


def batch_slices(starts: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, so that work arrays stay small; one text may be longer."""
    out, at = [], 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        out.append((at, to))
        at = to
    return out
