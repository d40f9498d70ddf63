"""Exact top-k inner products by a bit-sliced index.

Each component becomes a whole number; a block of vectors keeps its leading bits as bit slices, one bitmap per component and
bit. A query's scores for the whole block are sums of those bitmaps (carry-save additions, a bit of the query's component
shifts a slice, a negative one takes its complement). The top rows are selected from the most significant slice downward.
The bits that the slices leave out bound the error; all rows within it of the k-th are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitetide.llm.blocks import fits, meet, scaled, whole_numbers
from sitetide.llm.common import lookup, staged
from sitetide.session import ship_package

#: Vectors of a block, and the leading bits of a component that are sliced.
VECTORS, PLANES = 16384, 5
SCALE = 256.0
#: With larger numbers in a block all its rows are scored exactly.
SLICED_BELOW = 1 << 24


class SlicedBlock:
    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values, (n, d) = ids, values, values.shape
        self.low = values.min(axis=0) if n else np.zeros(d, np.int64)
        above = values - self.low
        self.shift = max(0, int(above.max(initial=0)).bit_length() - PLANES)
        self.plain = np.abs(values).max(initial=0) >= SLICED_BELOW
        leading = above >> self.shift
        self.middle = (2 ** self.shift - 1) / 2
        rest = above - (leading << self.shift) - self.middle
        self.error = float(np.sqrt((rest * rest).sum(axis=1).max(initial=0)))
        self.words = -(-n // 64)
        bits = np.zeros((d, PLANES, self.words * 64), dtype=bool)
        for b in range(PLANES):
            bits[:, b, :n] = (leading.T >> b) & 1
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.valid = self._packed(np.ones(n, dtype=bool))

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros(self.words * 64, dtype=bool)
        full[:len(flags)] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the sum over components of query times leading bits, plus the returned whole number."""
        size, half = np.abs(query), np.abs(query) >> 1
        carried = size + half
        signed = half ^ carried  # digits -1, 0, 1 of which no two neighbours differ from 0
        plus, minus = carried & signed, half & signed
        plus, minus = np.where(query < 0, minus, plus), np.where(query < 0, plus, minus)
        top = int(max(plus.max(initial=0), minus.max(initial=0))).bit_length()
        columns: list[list[np.ndarray]] = [[] for _ in range(top + PLANES)]
        added = 0
        for digit in range(top):
            for sign, digits in ((1, plus), (-1, minus)):
                which = np.flatnonzero((digits >> digit) & 1)
                for b in range(PLANES if len(which) else 0):
                    slices = self.slices[which, b]
                    columns[digit + b].append(slices if sign > 0 else ~slices)
                    added += 0 if sign > 0 else len(which) << (digit + b)
        out, weight = [], 0
        while weight < len(columns):
            held = np.concatenate(columns[weight]) if columns[weight] else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(held) > 2:
                third = len(held) // 3
                a, b, c = held[:third], held[third:2 * third], held[2 * third:3 * third]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                held = np.concatenate([odd ^ c, held[3 * third:]])
            if len(held) == 2:
                carries.append((held[0] & held[1])[None])
                held = (held[0] ^ held[1])[None]
            out.append(held[0] if len(held) else np.zeros(self.words, np.uint64))
            if carries:
                if weight + 1 == len(columns):
                    columns.append([])
                columns[weight + 1] += carries
            weight += 1
        return out, added

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows with another id; ties go to the smaller id."""
        wanted = self.valid & self._packed(self.ids != query_id)
        rows = np.flatnonzero(self.ids != query_id)
        if not self.plain and len(rows) > k:
            slices, _ = self.sums(query)
            sure, even, bound = np.zeros_like(wanted), wanted, 0
            for weight in range(len(slices) - 1, -1, -1):
                ones = even & slices[weight]
                if int(np.bitwise_count(sure | ones).sum()) >= k:
                    even, bound = ones, bound | 1 << weight
                else:
                    sure, even = sure | ones, even & ~slices[weight]
            slack = 2 * float(np.sqrt((query.astype(float) ** 2).sum())) * self.error / 2 ** self.shift
            bound = max(0, bound - math.ceil(slack * (1 + 1e-9)) - 1)
            above, even = np.zeros_like(wanted), wanted
            for weight in range(len(slices) - 1, -1, -1):
                if bound >> weight & 1:
                    even = even & slices[weight]
                else:
                    above, even = above | (even & slices[weight]), even & ~slices[weight]
            rows = np.flatnonzero(np.unpackbits((above | even).view(np.uint8), bitorder="little"))
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors by the inner product of whole numbers floor(256 x).

    Only vectors of the query's length with another vec_id count; ties go to the smaller vec_id; repeated rows count each, a
    repeated query id asks once (with its smallest vector). Rows with a null id, a null vector, or a null or non-finite
    component or one so large that scores might not fit 64 bits (``blocks.fits``) take no part; other columns are ignored; empty tables give no rows; fewer
    than k vectors are all returned.

    Vectors are dealt into blocks by numbers that are written down first, so a repeated task deals them alike. They move
    once; a block's slices are built once, and all queries stream past it, a batch at a time. A block returns k rows a query.
    """
    ship_package(vectors.sparkSession)
    def proper(df: DataFrame) -> DataFrame:
        given = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("x")).filter(F.col("vec_id").isNotNull() & fits("x", SCALE))
        return given.select("vec_id", scaled("x", SCALE).alias("x")).withColumn("size", F.size("x"))

    given = staged(proper(vectors).withColumn("row", F.monotonically_increasing_id()))
    asked = proper(queries).groupBy("vec_id").agg(F.min(F.struct("x", "size")).alias("q")).select("vec_id", "q.x", "q.size")
    counted = given.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    sizes = staged(counted.select(F.col("size"), F.ceil(F.col("n") / VECTORS).alias("parts")))
    few = lookup(sizes, sizes.count())
    blocks = given.join(few, "size").select(F.col("size").alias("cell"), F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "vec_id", "x")
    asks = asked.join(few, "size").select(
        F.col("size").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "vec_id", "x")

    def build(rows: pa.Table) -> SlicedBlock:
        return SlicedBlock(rows["vec_id"].to_numpy(), whole_numbers(rows["x"]))

    def search(index: SlicedBlock, batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[list] = [[], [], []]
        for query_id, query in zip(batch.column("vec_id").to_numpy(), whole_numbers(batch.column("x")), strict=True):
            ids, scores = index.top(query_id, query, k)
            for to, values in zip(found, ([query_id] * len(ids), ids, scores), strict=True):
                to.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    best = meet(blocks, asks, build, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
