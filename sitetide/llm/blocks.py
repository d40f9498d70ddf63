"""Searches that bring every query to blocks of rows, with one block and one batch of queries in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits(vector: str, scale: float, most: float = 2.0 ** 62) -> Column:
    """All components are finite numbers, and so small that sums of products of two vectors' numbers floor(scale * x) stay
    below ``most``, hence are 64-bit numbers."""
    bound = F.least(F.lit(2.0 ** 31 - 1), F.sqrt(F.lit(most) / F.greatest(F.size(vector), F.lit(1))))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < bound))


def scaled(vector: str, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def meet(rows: DataFrame, asks: DataFrame, build: Callable[[pa.Table], Any], answer: Callable[[Any, pa.RecordBatch], pa.RecordBatch], schema: str,
         empty: bool = False) -> DataFrame:
    """What ``answer`` gives for the index that ``build`` makes of a block's rows and each batch of the block's queries.

    Both sides have the same columns; (cell, part) names the block. Rows are moved to their block once. A block's rows are
    sorted before its queries, so its index is built once and the queries stream past, however many there are. Queries of a
    block without rows are passed over, or with ``empty`` meet the index of none.
    """
    both = rows.withColumn("_asks", F.lit(0)).unionByName(asks.withColumn("_asks", F.lit(1)))
    met = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            cell, part, kind = (batch.column(c).to_numpy() for c in ("cell", "part", "_asks"))
            new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (cell[a], part[a]) != key:
                    key, held, index = (cell[a], part[a]), [], None
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(piece)
                elif held or empty:
                    if index is None:
                        index = build(pa.Table.from_batches(held, piece.schema))
                    yield answer(index, piece)

    return met.mapInArrow(run, schema)


def whole_numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy()
    return flat.astype(np.int64).reshape(len(column), len(flat) // len(column) if len(column) else 0)
