"""Vector code compression (product quantisation) by Lloyd rounds whose members stay where they are.

A vector is cut into parts; a part's position has a codebook, and the part's code is the index of the nearest entry. A part
lives with the owner of its entry: rows are dealt by (position, entry, salt), so that an entry with a third of all parts has
as many owners as its size asks for. A round has three steps:

1. owners sum their resident members; the sums of an entry's owners give its new components;
2. the new codebooks, whose size is a product of parameters, go to all members, which look for their nearest entry;
3. members that change entry are written apart and shuffled to their new owners; all others stay in their files.

So after the first placement a shuffle carries the movers only. Each generation of members is a table in the shared folder:
a lost executor repeats tasks of one step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.llm.blocks import fits, scaled
from sitetide.llm.common import delete_path, goes_at_end, scratch_path, staged
from sitetide.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Members of one owner, on average, if all parts of a position had one entry.
MEMBERS = 1 << 9
#: Sums of products of two vectors' whole numbers stay below this, so squared distances fit 64 bits.
MOST = 2.0 ** 60
#: Rows whose distances to a codebook are computed at once.
_ROWS = 4096


@dataclass(frozen=True)
class Compressed:
    """codes: the kept columns, ``entries`` (an entry of each part's codebook) and ``error`` (squared distances, summed);
    codebooks: for each part its entries, one a row, as whole numbers."""

    codes: DataFrame
    codebooks: list[np.ndarray]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower index) and the squared distance to it, in whole numbers.

    Floating point is used where its whole numbers are exact, which doesn't change a result.
    """
    most = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    entries = book.astype(kind)
    own = (entries * entries).sum(axis=1)
    index, error = np.zeros(len(points), np.int32), np.zeros(len(points), np.int64)
    for at in range(0, len(points), _ROWS):
        some = points[at:at + _ROWS].astype(kind)
        apart = own - 2 * (some @ entries.T)
        best = apart.argmin(axis=1)
        index[at:at + _ROWS] = best
        error[at:at + _ROWS] = apart[np.arange(len(some)), best] + (some * some).sum(axis=1)
    return index, error


def _by_part(batch: pa.RecordBatch, widths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows of the batch, their numbers) for each part that the batch has."""
    part, lists = batch.column("part").to_numpy(), batch.column("x")
    offsets, numbers = lists.offsets.to_numpy(), lists.values.to_numpy()
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        yield int(p), rows, numbers[offsets[rows][:, None] + np.arange(widths[p])].astype(np.int64)


def assigned(members: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """The members (row, part, x, entry) with their nearest entry, its squared distance, and whether that is another entry."""
    widths = [book.shape[1] for book in codebooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, numbers in _by_part(batch, widths):
                entry[rows], error[rows] = nearest(numbers, codebooks[p])
            moves = entry != batch.column("entry").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("part"), batch.column("x"), *map(pa.array, (entry, error, moves))],
                ["row", "part", "x", "entry", "error", "moves"])

    return members.select("row", "part", "x", "entry").mapInArrow(run, "row long, part int, x array<int>, entry int, error long, moves boolean")


def updated(members: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by floor(sum / count) of its members' numbers; an entry without members stays.

    Owners add up what lives with them, so a row for each entry and component leaves a task, not a member.
    """
    widths, shapes = [book.shape[1] for book in codebooks], [book.shape for book in codebooks]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((n, width + 1), np.int64) for n, width in shapes]  # the last column counts
        for batch in batches:
            entry = batch.column("entry").to_numpy()
            for p, rows, numbers in _by_part(batch, widths):
                order = np.argsort(entry[rows], kind="stable")
                found, first = np.unique(entry[rows][order], return_index=True)
                whole = np.column_stack([numbers, np.ones(len(numbers), np.int64)])[order]
                sums[p][found] += np.add.reduceat(whole, first, axis=0)
        for p, total in enumerate(sums):
            e, c = np.nonzero(np.repeat(total[:, -1:] > 0, total.shape[1], axis=1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[e, c])],
                ["part", "entry", "component", "n"])

    partial = members.select("part", "x", "entry").mapInArrow(add, "part int, entry int, component int, n long")
    rows = partial.groupBy("part", "entry", "component").agg(F.sum("n").alias("n")).toArrow()  # at most a codebook's numbers
    part, entry, component, n = (rows[c].to_numpy() for c in ("part", "entry", "component", "n"))
    out = []
    for p, book in enumerate(codebooks):
        mine = part == p
        total = np.zeros((book.shape[0], book.shape[1] + 1), np.int64)
        total[entry[mine], component[mine]] = n[mine]
        used = total[:, -1] > 0
        book = book.copy()
        book[used] = total[used, :-1] // total[used, -1:]
        out.append(book)
    return out


class Members:
    """The current generation of members: files of those that stayed, and of those that arrived by the last shuffle."""

    def __init__(self, spark, salts: int) -> None:
        self.spark, self.salts, self.paths = spark, salts, []

    def moved(self, assignment: DataFrame) -> DataFrame:
        """The next generation: members that change entry go to their new owners, the others are written where they are."""
        here, there = scratch_path(self.spark), scratch_path(self.spark)
        assignment.drop("error").write.partitionBy("moves").parquet(here)
        goes_at_end(self.spark, here)
        schema = "row long, part int, x array<int>, entry int"
        sides = self.spark.read.schema(schema + ", moves boolean").parquet(here)
        salt = F.pmod(F.xxhash64("row"), F.lit(self.salts))
        sides.filter("moves").drop("moves").repartition("part", "entry", salt).write.parquet(there)
        goes_at_end(self.spark, there)
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = [here, there]
        return sides.filter("NOT moves").drop("moves").union(self.spark.read.schema(schema).parquet(there))

    def over(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)


def compress(vectors: DataFrame, keep: Sequence[str] = ("vec_id",), vector: str = "embedding", order: Column | None = None, n_parts: int = PARTS,
             n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Compressed:
    """Codes of ``n_parts`` whole numbers for each vector, and the codebooks that they refer to.

    Components become floor(scale * x). The codebooks start as the parts of the ``n_entries`` first vectors by ``order`` (by
    default vec_id, nulls last; ties by the vector), fewer if there are fewer; each round assigns all parts to their nearest
    entry (ties to the lower index) and replaces each entry by floor(sum / count) of its parts; unused entries stay. The
    codes are of a last assignment.

    Left out are rows whose vector is null or holds null or non-finite components or some so large that distances might not
    fit 64 bits (``blocks.fits``), and vectors of another length than the most frequent one (ties: the longest). A length that isn't a multiple of ``n_parts``
    gives parts that differ by one component; empty vectors have empty parts, entry 0 and error 0. Null ids are rows like
    others; repeated rows count each; only the columns in ``keep`` are returned, whatever others there are; an empty table
    gives no codes and codebooks without entries.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), F.col(vector).alias("v"),
                           (F.col("vec_id") if order is None else order).alias("place"))
    # the row numbers are written down: later steps meet the same ones, whichever task is repeated
    rows = staged(given.filter(fits("v", scale, MOST)).select(F.monotonically_increasing_id().alias("row"), "given", "place", scaled("v", scale).alias("x")))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    size, n_rows = (lengths["n"], lengths["count"]) if lengths else (0, 0)
    rows = rows.filter(F.size("x") == size)
    cuts = [size * i // n_parts for i in range(n_parts + 1)]
    first = rows.orderBy(F.col("place").asc_nulls_last(), "x").select("x").limit(n_entries).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), size)
    codebooks = [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    pieces = F.array(*[F.slice("x", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
    members = rows.select("row", F.posexplode(pieces).alias("part", "x")).withColumn("entry", F.lit(-1))
    generations = Members(spark, max(1, -(-n_rows // MEMBERS)))
    for _ in range(rounds if n_rows else 0):
        members = generations.moved(assigned(members, codebooks))
        codebooks = updated(members, codebooks)
    coded = assigned(members, codebooks).groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "entry"))), lambda s: s["entry"]).alias("entries"), F.sum("error").alias("error"))
    codes = staged(rows.select("row", "given").join(coded, "row").select("given.*", "entries", "error"))
    generations.over()
    return Compressed(codes, codebooks)


def decompress(entries: Sequence[int], codebooks: list[np.ndarray], scale: float = SCALE) -> np.ndarray:
    """The vector that a code stands for: its entries one after the other, in the middle of the whole numbers' steps."""
    return (np.concatenate([book[e] for e, book in zip(entries, codebooks, strict=True)]) + 0.5) / scale
