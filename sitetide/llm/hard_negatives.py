"""Hard negatives by coordinate pruning in buckets of vectors of like length.

Vectors are dealt into buckets of similar length and bounded size. A bucket keeps, for each coordinate, the sorted list of its
vectors' directions. An anchor that needs a score of at least ``least`` needs a direction within the angle whose cosine is
least / (its length * the bucket's largest length); so each of its focus coordinates, the largest ones, has a range of
feasible values, read off the sorted list. What is in all ranges is scored exactly. The same search finds the anchors'
positives, within their label; there ``least`` comes from a few vectors at the favourable end of a list.

Vectors move once, to their bucket. Anchors come to the buckets whose length allows their scores, and stream past: a task
holds one bucket and one batch of anchors, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitetide.llm.blocks import fits, meet, scaled, whole_numbers
from sitetide.llm.common import LOOKUP_ROWS, staged
from sitetide.operators.joins import join_hot
from sitetide.session import ship_package

SCALE = 256.0
#: Numbers of a bucket (its vectors times their components), and the ratio of the lengths that share a bucket.
NUMBERS, RATIO = 1 << 20, 1.2
#: Focus coordinates of an anchor, and vectors that are scored to begin with for each one that is wanted.
FOCUS, SEEDS = 4, 8
#: Kept between what floating point finds and the exact bounds.
_SLACK = 1e-7

Answer = Callable[["Bucket", dict], Iterator[tuple]]


class Bucket:
    """Vectors of similar length as sorted lists of their directions' coordinates."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: list, numbers: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[x] for x in labels], np.int64)
        self.most, self.numbers = int(np.abs(numbers).max(initial=0)), numbers
        length = np.sqrt((numbers.astype(np.float64) ** 2).sum(axis=1))
        self.longest, self.shortest = length.max(initial=0), length.min(initial=np.inf)
        self.unit = numbers / np.where(length > 0, length, 1)[:, None]
        self.exact: np.ndarray | None = None
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def listed(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = self.unit[order, coordinate], order
        return self.lists[coordinate]

    def scores(self, query: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact inner products; in floating point where its whole numbers are exact."""
        if len(query) * self.most * int(np.abs(query).max(initial=0)) < 1 << 53:
            if self.exact is None:
                self.exact = self.numbers.astype(np.float64)
            return (self.exact[which] @ query.astype(np.float64)).astype(np.int64)
        return self.numbers[which] @ query

    def focus(self, query: np.ndarray) -> np.ndarray:
        return np.argsort(-np.abs(query), kind="stable")[:FOCUS]

    def feasible(self, query: np.ndarray, least: int) -> np.ndarray:
        """The vectors whose focus coordinates allow a score of ``least``: a superset of those that have it."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        other = self.longest if least >= 0 else self.shortest
        everything = np.arange(len(self.rows))
        if length * other == 0:
            return everything if least <= 0 or self.longest * length > 0 else everything[:0]
        cosine = least / (length * other) - _SLACK
        if cosine > 1:
            return everything[:0]
        if cosine <= -1:
            return everything
        angle = np.arccos(cosine)
        focus = self.focus(query)
        own = np.arccos(np.clip(query[focus] / length, -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - _SLACK, np.cos(np.maximum(0, own - angle)) + _SLACK
        ranges = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            values, order = self.listed(f)
            ranges.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, side="right")), order, f, a, b))
        ranges.sort(key=lambda r: r[1] - r[0])
        first, last, order, *_ = ranges[0]
        found = order[first:last]
        for first, last, _, f, a, b in ranges[1:]:
            if last - first < len(self.rows):
                at = self.unit[found, f]
                found = found[(at >= a) & (at <= b)]
        return found

    def best(self, query: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the wanted vectors (a mask), and their scores; ties to the smaller id."""
        values, order = self.listed(int(self.focus(query)[0])) if len(query) else (None, np.arange(len(self.rows)))
        if len(query) and query[self.focus(query)[0]] > 0:
            order = order[::-1]
        seeds = order[wanted[order]][:SEEDS * k]
        if len(seeds) < k:
            found = seeds
        else:
            found = self.feasible(query, int(np.sort(self.scores(query, seeds))[-k]))
            found = found[wanted[found]]
        return self.first(found, self.scores(query, found), k)

    def first(self, which: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(which) > 8 * k:
            enough = scores >= np.partition(scores, -k)[-k]
            which, scores = which[enough], scores[enough]
        order = np.lexsort((self.rows[which], self.ids[which], -scores))[:k]
        return which[order], scores[order]


_ASK = "array<struct<rank:int,id:bigint,score:bigint>>"


def searched(vectors: DataFrame, asks: DataFrame, answer: Answer, names: list[str], schema: str) -> DataFrame:
    """What ``answer`` gives for each ask and bucket. Both sides: cell, part (the bucket), row, vec_id, label, x; asks also
    ``positives``."""
    columns = ["cell", "part", "row", "vec_id", "label", "x", "positives"]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    arrow = [kinds[field.split()[1]] for field in schema.split(", ")]

    def build(rows: pa.Table) -> Bucket:
        return Bucket(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["label"].to_pylist(), whole_numbers(rows["x"]))

    def replies(bucket: Bucket, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        plain = (batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "positives"))
        for row, vec_id, label, positives, x in zip(*plain, whole_numbers(batch.column("x")), strict=True):
            out += answer(bucket, {"row": row, "vec_id": vec_id, "label": label, "x": x, "positives": positives})
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), arrow, strict=True)], names)

    return meet(vectors.withColumn("positives", F.lit(None).cast(_ASK)).select(columns), asks.select(columns), build, replies, schema)


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """A cell for each length class (and label, if in ``by``): its number, largest squared length and number of buckets."""
    vectors = F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.greatest(F.col("size"), F.lit(1))))
    counted = rows.groupBy(*by, "class").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top"))
    return staged(counted.select(F.monotonically_increasing_id().alias("cell"), *by, "class", "top", F.ceil(F.col("n") / vectors).alias("parts")))


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str], n_cells: int) -> DataFrame:
    """Few cells go to all workers; beyond that a hot key's rows are salted."""
    return rows.join(F.broadcast(cells), keys) if n_cells <= LOOKUP_ROWS else join_hot(rows, cells, keys, ["row"])


def mine(vectors: DataFrame, anchors: Column, label: str = "label", vector: str = "embedding", n_positives: int = 5, n_negatives: int = 5,
         lowest: int = 80, highest: int = 100, scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank): hard negatives of each anchor and positive.

    Scores are inner products of the whole numbers floor(scale * x). Anchors are the rows for which ``anchors`` holds; their
    positives the ``n_positives`` best other rows of their label; the negatives of a positive the ``n_negatives`` best rows of
    other labels with a score of ``lowest`` to ``highest`` hundredths of the positive's. Higher scores come first, then smaller
    ids. Positives without negatives, as all with a negative score are, give no rows.

    Rows with a null id, label or vector, or with null or non-finite components or some so large that scores might not fit
    64 bits (``blocks.fits``), take no part; vectors are compared with those of their length; repeated rows count each, as anchors, positives and negatives, and
    are other rows to each other; further columns are ignored; an empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    square = F.aggregate("x", F.lit(0).cast("long"), lambda total, n: total + n.cast("long") * n.cast("long"))
    length_class = F.when(F.col("square") > 0, F.floor(F.log(F.col("square").cast("double")) / F.lit(2 * np.log(RATIO)))).otherwise(-1)
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
                           F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    sized = given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fits("v", scale)).select(
        "row", "vec_id", "label", "anchor", scaled("v", scale).alias("x"))
    rows = staged(sized.withColumns({"square": square, "size": F.size("x")}).withColumn("class", length_class))
    asking = rows.filter("anchor").drop("anchor", "class")

    def dealt(keys: list[str], cells: DataFrame, n_cells: int) -> DataFrame:
        part = F.pmod(F.xxhash64("row"), F.col("parts"))
        return _joined(rows, cells.drop("top"), [*keys, "class"], n_cells).select("cell", part.alias("part"), "row", "vec_id", "label", "x")

    def sent(asks: DataFrame, keys: list[str], cells: DataFrame, n_cells: int, reach: Column) -> DataFrame:
        near = _joined(asks, cells.drop("class"), keys, n_cells).filter(reach)
        return near.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "row", "vec_id", "label", "x", "positives")

    # positives: buckets of the anchor's own label
    keys = ["label", "size"]
    cells = _cells(rows, keys)
    n_cells = cells.count()

    def positives_of(bucket: Bucket, ask: dict) -> Iterator[tuple]:
        code = bucket.codes.get(ask["label"], -1)
        found, scores = bucket.best(ask["x"], n_positives, (bucket.labels == code) & (bucket.rows != ask["row"]))
        yield from zip([ask["row"]] * len(found), bucket.rows[found].tolist(), bucket.ids[found].tolist(), scores.tolist(), strict=True)

    none = F.lit(None).cast(_ASK)
    likely = searched(dealt(keys, cells, n_cells), sent(asking.withColumn("positives", none), keys, cells, n_cells, F.lit(True)), positives_of,
                      ["row", "other", "id", "score"], "row long, other long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "id", "other")
    chosen = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_positives).filter("score >= 0").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most n_positives a row
    asks = staged(asking.join(chosen, "row"))

    # negatives: all buckets whose vectors are long enough
    by_size = _cells(rows, ["size"])
    n_sizes = by_size.count()
    least = F.array_min(F.transform("positives", lambda p: p["score"])) * F.lit(lowest / 100)
    long_enough = F.sqrt(F.col("square").cast("double")) * F.sqrt(F.col("top").cast("double")) * (1 + _SLACK) >= least * (1 - _SLACK)

    def negatives_of(bucket: Bucket, ask: dict) -> Iterator[tuple]:
        bounds = [(p, -(-lowest * p["score"] // 100), highest * p["score"] // 100) for p in ask["positives"]]
        found = bucket.feasible(ask["x"], min(low for _, low, _ in bounds))
        found = found[bucket.labels[found] != bucket.codes.get(ask["label"], -1)]
        scores = bucket.scores(ask["x"], found)
        for p, low, high in bounds:
            within = np.flatnonzero((scores >= low) & (scores <= high))
            best, score = bucket.first(found[within], scores[within], n_negatives)
            for row, vec_id, s in zip(bucket.rows[best].tolist(), bucket.ids[best].tolist(), score.tolist(), strict=True):
                yield ask["row"], ask["vec_id"], p["rank"], p["id"], p["score"], row, vec_id, s

    names = ["row", "anchor_id", "positive_rank", "positive_id", "positive_score", "other", "negative_id", "negative_score"]
    hard = searched(dealt(["size"], by_size, n_sizes), sent(asks, ["size"], by_size, n_sizes, long_enough), negatives_of, names,
                    ", ".join(f"{n} {'int' if n == 'positive_rank' else 'long'}" for n in names))
    order = Window.partitionBy("row", "positive_rank").orderBy(F.col("negative_score").desc(), "negative_id", "other")
    return hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
