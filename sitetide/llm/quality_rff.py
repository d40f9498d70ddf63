"""Document quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over the standardised statistics. Each partition sums its part of the normal
equations by fold; a tree adds the partitions, and the driver solves one small system per fold. Scores of rows that a fold
left out, pooled in bins, give the calibration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.llm.common import batch_slices, handing_back, staged, text_buffer, word_bounds, word_hashes
from sitetide.session import ship_package

N_STATISTICS = 18
FOLDS = 3
#: Partial sums that one task of a level adds up; the last level's, at most so many, reach the driver.
SUBTREES = 16
#: Bins of raw scores that calibration pools, over [-1, 2).
BINS = 3072

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = np.isin(_CODES, [0x20, *range(0x09, 0x0E)])
_SENTENCE = np.isin(_CODES, [ord(c) for c in ".,;:'\"()-"])
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _SENTENCE)


def statistics(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """N_STATISTICS numbers for each text of a buffer; all are 0 for an empty text."""
    n = np.diff(starts)

    def per_text(flags: np.ndarray, at: np.ndarray = starts) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])
        return np.diff(sums[at])

    begin, end, first = word_bounds(raw, starts)
    words, size = np.diff(first), (end - begin).astype(np.float64)
    text_of = np.repeat(np.arange(len(n)), words)
    final = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    per_word = lambda flags: per_text(flags, first)
    bytes_, count = np.maximum(n, 1), np.maximum(words, 1)
    letters = np.maximum(per_text(_LETTER[raw]), 1)

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, text_of))
        new = np.ones(len(order), dtype=bool)
        v, t = values[order], text_of[order]
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        return per_word(new)

    hashes = word_hashes(raw, begin, end)
    pairs = hashes.copy()
    pairs[1:] += hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw], dtype=np.float64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.float64)])
    in_word = symbols[end] - symbols[begin] if len(end) else np.zeros(0)
    mean = per_word(size) / count
    lines = per_text(raw == 10) + 1
    columns = [
        np.log1p(n), np.log1p(words), per_text(_UPPER[raw]) / letters, per_text(_DIGIT[raw]) / bytes_,
        per_text(_SPACE[raw]) / bytes_, per_text(_SENTENCE[raw]) / bytes_, per_text(_SYMBOL[raw]) / bytes_,
        per_text(raw >= 128) / bytes_, mean, np.sqrt(np.maximum(per_word(size * size) / count - mean * mean, 0)),
        distinct(hashes) / count, distinct(pairs) / count, per_word(_SYMBOL[final]) / count, per_word(in_word == size) / count,
        per_word(size == 1) / count, np.log1p(n / lines),
        per_word((upper[end] - upper[begin] >= 2) if len(end) else np.zeros(0)) / count, per_word(_SENTENCE[final]) / count,
    ]
    return np.where(n[:, None] > 0, np.stack(columns, axis=1), 0.0)


@dataclass
class Model:
    """What scoring needs; some ten KB."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.frequencies + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2.0 / len(self.phases)), np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        # rounded, as the last bits depend on which rows share a batch
        return np.round(np.interp(self.features(x) @ self.weights, self.knots, self.levels), 9)


def tree_sum(df: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``terms`` (``size`` numbers a batch) over all rows: within partitions, then level by level over SUBTREES of them."""
    schema = "part binary"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += terms(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = staged(df.mapInArrow(within, schema))
    n = parts.count()
    while n > SUBTREES:
        n = -(-n // SUBTREES)
        parts = staged(parts.repartition(n).mapInArrow(across, schema))
    return sum((np.frombuffer(row["part"]) for row in parts.collect()), np.zeros(size))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled means of y that never fall as x rises: the blocks' means of x and of y."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, w2 = blocks.pop()
            a1, b1, w1 = blocks[-1]
            blocks[-1] = [(a1 * w1 + a2 * w2) / (w1 + w2), (b1 * w1 + b2 * w2) / (w1 + w2), w1 + w2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its statistics (array<double>)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(_of_texts(batch.column(text)))], ["doc_id", "stats"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select("doc_id", text).mapInArrow(handing_back(run), schema)


def _of_texts(column: pa.Array) -> np.ndarray:
    raw, starts = text_buffer(column)
    parts = [statistics(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a]) for a, b in batch_slices(starts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, train: Column, **given) -> Model:
    """``fit_statistics`` of the texts of ``docs``. The texts don't move: their statistics are joined with the labels."""
    return fit_statistics(document_statistics(docs), labels, train, **given)


def fit_statistics(stats: DataFrame, labels: DataFrame, train: Column, n_features: int = 128, bandwidth: float = 4.0, ridge: float = 1e-3,
                   seed: int = 41) -> Model:
    """Learn ``labels.quality`` of the rows where ``train`` (of doc_id) holds; all of them, streamed, none sampled.

    Rows without a label or with a null one, and labels without a document, take no part; a label given twice, or for an id
    that several documents have, counts for each pair. Without any training row the score is 0.5 for all.
    """
    wanted = labels.filter(F.col("quality").isNotNull() & train).select("doc_id", F.col("quality").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = staged(stats.join(wanted, "doc_id").select("stats", "label", fold.alias("fold")))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("stats"))
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = tree_sum(rows, moments, 1 + 2 * N_STATISTICS)
    n = max(total[0], 1.0)
    mean = total[1:1 + N_STATISTICS] / n
    variance = total[1 + N_STATISTICS:] / n - mean * mean
    random = np.random.default_rng(seed)
    model = Model(mean, np.sqrt(np.maximum(variance, 1e-8)), random.normal(size=(N_STATISTICS, n_features)) / bandwidth,
                  random.uniform(0, 2 * np.pi, n_features))
    if not total[0]:
        return model
    d = n_features + 1

    def normal_equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, k = model.features(_matrix(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        out = np.zeros((FOLDS, d, d + 1))
        for i in range(FOLDS):
            own = z[k == i]
            out[i, :, :d], out[i, :, d] = own.T @ own, own.T @ y[k == i]
        return out.ravel()

    by_fold = tree_sum(rows, normal_equations, FOLDS * d * (d + 1)).reshape(FOLDS, d, d + 1)
    solve = lambda s: np.linalg.solve(s[:, :d] + ridge * n * np.eye(d) / d, s[:, d])
    whole = by_fold.sum(axis=0)
    left_out = np.stack([solve(whole - by_fold[i]) for i in range(FOLDS)])

    def pooled(batch: pa.RecordBatch) -> np.ndarray:
        z, y, k = model.features(_matrix(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        s = (z * left_out[k]).sum(axis=1)
        at = np.clip((s + 1) / 3 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, w, BINS) for w in (np.ones(len(s)), s, y)])

    count, score, label = tree_sum(rows, pooled, 3 * BINS).reshape(3, BINS)
    full = count > 0
    model.weights = solve(whole)
    model.knots, model.levels = isotonic(score[full] / count[full], label[full] / count[full], count[full])
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of the rows of ``document_statistics``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(sent.value.score(_matrix(batch.column("stats"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """The columns of ``docs`` and the score (0 to 1, higher: label 1 likelier) of the whole text; null is scored as empty.

    Narrow. Only the text is an input. A column named like ``score`` is replaced; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop(score)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(sent.value.score(_of_texts(batch.column(text))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score])

    return docs.mapInArrow(handing_back(run), schema)
