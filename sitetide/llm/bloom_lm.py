"""A bigram language model in a log-frequency Bloom filter, and exact smoothed unigram scores beside it.

A count c is held as the level 1 + floor(log2 c): the n-gram is put into the filter once for each level up to its own, and
probing level after level until one is missing gives the level back. The filter consists of chunks; an n-gram's hash names
its chunk, so each chunk is built in one task from the counts of its n-grams. The filter's size is proportional to the
training tokens, without a bound: no process holds all of it, n-grams go to their chunk to be looked up.

Tokens are 64-bit hashes of lower-cased words. A block of texts keeps its tokens and sends one array of distinct keys to each
part, a range of chunks: an n-gram costs its chunk one key a block, the most frequent one no more than any other, and a block
makes at most MOST_PARTS rows, however many chunks there are. Blocks stream past the chunks of their part.

A counted n-gram is discounted before it is divided by its history, as what was seen once says little: its probability is
weight * max(count - DISCOUNT, 0) / count of the history, plus (1 - weight) times the smoothed one of the word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.llm.blocks import meet
from sitetide.llm.common import batch_slices, mix, staged, text_buffer, word_bounds, word_hashes
from sitetide.session import ship_package

#: Stand for the end of a text, a token of its own, and for what precedes its first token.
END, START = np.uint64(0x51ED270B9F2C4D17), np.uint64(0xA3C59AC2F0136D89)
PROBES = 3
#: Bytes of hashes in a block, and tokens for which there is one more hash range.
BLOCK, RANGE_TOKENS = 8 << 20, 1 << 20
FINGERPRINT = np.uint64((1 << 32) - 1)
#: Bytes of a key that travel; a chunk and 32 bits tell bigrams apart (two of a chunk's million share them once in 4,000).
WORD_BYTES, PAIR_BYTES = 8, 4
#: Ranges of chunks that blocks address, at most, and bytes of a chunk's n-grams that its part holds back to send together.
MOST_PARTS, HELD_BACK = 1 << 13, 1 << 18
DISCOUNT = 0.75


def tokens_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then END, and where each text's tokens start."""
    begin, end, first = word_bounds(raw, starts)
    words = np.diff(first)
    at = np.concatenate([[0], np.cumsum(words + 1)])
    out = np.full(at[-1], END, dtype=np.uint64)
    is_word = np.ones(len(out), dtype=bool)
    is_word[at[1:] - 1] = False
    out[is_word] = word_hashes(raw, begin, end)
    return out, at


def batch_tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, tokens, starts) of slices of a batch's texts."""
    raw, starts = text_buffer(column)
    for a, b in batch_slices(starts):
        yield a, b, *tokens_of(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])


def histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; START at the beginning of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[starts[:-1]] = START
    return out


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ np.uint64(0x1F83D9ABFB41BD6B))


def bigram_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return pair_keys(unigram_keys(before), unigram_keys(tokens))


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Bigrams' keys from their tokens' keys."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next: high bytes, mostly zero, stand together and compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@lru_cache(maxsize=4)
def range_bounds(n: int) -> np.ndarray:
    """First hashes of n equal ranges, and of none."""
    return np.array([-(-(i << 64) // n) for i in range(n)], dtype=np.uint64)


def first_chunks(n_chunks: int) -> np.ndarray:
    """The first chunk of each part, and the number of chunks at the end."""
    n_parts = min(n_chunks, MOST_PARTS)
    return np.arange(n_parts + 1) * n_chunks // n_parts


def part_of(chunk: Column, n_chunks: int) -> Column:
    """The part of a chunk, the reverse of ``first_chunks``."""
    return F.floor(((chunk.cast("long") + 1) * min(n_chunks, MOST_PARTS) - 1) / n_chunks).cast("long")


def in_parts(keys: np.ndarray, bounds: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[int, slice, bytes, bytes]]:
    """(part, where its keys are, the low bytes of these, how many there are for each of its chunks) for parts that have
    some of the ascending keys."""
    cut = np.append(np.searchsorted(keys, bounds), len(keys))
    packed = keys.view(np.uint8).reshape(-1, 8)[:, :width]
    for p in np.flatnonzero(np.diff(cut[first])):
        a, b = first[p], first[p + 1]
        yield int(p), slice(cut[a], cut[b]), packed[cut[a]:cut[b]].tobytes(), np.diff(cut[a:b + 1]).astype(np.uint32).tobytes()


def summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their weights (their number)."""
    if weights is None:
        unique, n = np.unique(keys, return_counts=True)
        return unique, n
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


@dataclass
class Model:
    """What ``fit`` learnt. chunks: (chunk, bits, words, counts), the filter and the exact counts of words by hash range."""

    chunks: DataFrame
    n_chunks: int
    chunk_bits: int
    train_tokens: int
    distinct: int
    weight: float = 0.7

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """``middle`` of each key's level, for a few keys that the driver asks for."""
        chunk = np.searchsorted(range_bounds(self.n_chunks), keys, side="right") - 1
        bits = {r["chunk"]: np.frombuffer(r["bits"], np.uint8) for r in self.chunks.filter(F.col("chunk").isin(np.unique(chunk).tolist())).collect()}
        out = np.zeros(len(keys), np.uint8)
        for i in bits:
            out[chunk == i] = held_levels(bits[i], keys[chunk == i], self.chunk_bits)
        return middle(out)


def middle(levels: np.ndarray) -> np.ndarray:
    """Middle of the count range of each level, 0 for keys that the filter doesn't hold."""
    power = 2.0 ** levels
    return np.where(levels > 0, (power / 2 + power - 1) / 2, 0.0)


def held_levels(bits: np.ndarray, keys: np.ndarray, chunk_bits: int) -> np.ndarray:
    """Level of each key in the chunk that all of them belong to, 0 for keys that it doesn't hold."""
    out = np.zeros(len(keys), np.uint8)
    alive, level = np.arange(len(keys)), 0
    while len(alive) and level < 255:
        level += 1
        for probe in range(PROBES):
            at = position(keys[alive], level, probe, chunk_bits)
            hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
        out[alive] = level
    return out


def position(keys: np.ndarray, level: int, probe: int, chunk_bits: int) -> np.ndarray:
    """One of the PROBES bits of an n-gram's level within its chunk."""
    salt = np.uint64((level * PROBES + probe) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix((keys & FINGERPRINT) + salt) % np.uint64(chunk_bits)


# --- building the filter ------------------------------------------------------------------------------


def _ngram_blocks(train: DataFrame, text: str, n_chunks: int) -> DataFrame:
    """(part, n_order, keys, cuts, counts): n-grams of a block of texts, counted, one row for each part."""
    first = first_chunks(n_chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for _, _, tokens, starts in batch_tokens(batch.column(text)):
                before = histories(tokens, starts)
                held[0] += [unigram_keys(tokens), unigram_keys(np.full(len(starts) - 1, START))]
                held[1].append(bigram_keys(before, tokens))
                size += len(tokens)
                if size > 4 * RANGE_TOKENS:
                    yield flush(held)
                    held, size = [[], []], 0
        if size:
            yield flush(held)

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes, bytes, bytes]] = []
        for order, parts in enumerate(held, 1):
            keys, n = summed(np.concatenate(parts))
            n = n.astype(np.uint32)
            rows += [(p, order, low, cuts, n[at].tobytes()) for p, at, low, cuts in in_parts(keys, range_bounds(n_chunks), first, WORD_BYTES if order == 1 else PAIR_BYTES)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
            pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "n_order", "keys", "cuts", "counts"])

    return train.select(text).mapInArrow(run, "part int, n_order int, keys binary, cuts binary, counts binary")


def _by_chunk(blocks: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, n_order, keys, counts): what many blocks sent to a part, cut at its chunks and put together by chunk."""
    if n_chunks <= MOST_PARTS:  # a part is a chunk
        return blocks.select(F.col("part").alias("chunk"), "n_order", "keys", "counts")
    first, held_back = first_chunks(n_chunks), HELD_BACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        size: dict[tuple[int, int], int] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            size.pop(key)
            keys, counts = (b"".join(x) for x in zip(*held.pop(key), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([keys]), pa.array([counts])],
                                              ["chunk", "n_order", "keys", "counts"])

        for batch in batches:
            for part, order, keys, cuts, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width, at = WORD_BYTES if order == 1 else PAIR_BYTES, 0
                for i, n in enumerate(np.frombuffer(cuts, np.uint32).tolist()):
                    if n:
                        key = (int(first[part]) + i, order)
                        held.setdefault(key, []).append((keys[at * width:(at + n) * width], counts[4 * at:4 * (at + n)]))
                        size[key] = size.get(key, 0) + n * width
                        if size[key] > held_back:
                            yield row(key)
                    at += n
        for key in list(held):
            yield row(key)

    return blocks.repartition("part").select("part", "n_order", "keys", "cuts", "counts").mapInArrow(run, "chunk int, n_order int, keys binary, counts binary")


def unpacked(parts: list[bytes], width: int) -> np.ndarray:
    """Keys of which the lowest ``width`` bytes were kept."""
    packed = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :width] = packed
    return wide.view(np.uint64).ravel()


def _chunks(blocks: DataFrame, chunk_bits: int) -> DataFrame:
    """(chunk, bits, words, counts, distinct): the filter's chunks, keys and exact counts of the words in each, and the number of its tokens."""
    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(chunk_bits, dtype=bool)
        distinct, words, word_counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for order, width in ((1, WORD_BYTES), (2, PAIR_BYTES)):
            rows = table.filter(pa.compute.equal(table["n_order"], order))
            if not len(rows):
                continue
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"].to_pylist()]).astype(np.int64)
            keys, n = summed(unpacked(rows["keys"].to_pylist(), width), counts)
            if order == 1:
                words, word_counts = keys, n
                distinct = len(keys) - int((keys == unigram_keys(np.array([START]))[0]).sum())
            levels = np.frexp(n.astype(np.float64))[1]  # 1 + floor(log2 n)
            for level in range(1, int(levels.max()) + 1):
                for probe in range(PROBES):
                    bits[position(keys[levels >= level], level, probe, chunk_bits)] = True
        packed_bits = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"chunk": table["chunk"][:1], **{name: pa.array([x], pa.binary()) for name, x in (
            ("bits", packed_bits), ("words", words.tobytes()), ("counts", word_counts.tobytes()))}, "distinct": pa.array([distinct], pa.int64())})

    return blocks.groupBy("chunk").applyInArrow(build, "chunk int, bits binary, words binary, counts binary, distinct long")


def token_count(rows: DataFrame, text: str) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            raw, starts = text_buffer(batch.column(text))
            total += sum(len(word_bounds(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])[0]) + b - a for a, b in batch_slices(starts))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return rows.select(text).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def fit(train: DataFrame, text: str = "text", bits_per_token: int = 6, probed: int = 0) -> Model:
    """Learn from all texts. The filter has ``bits_per_token`` bits for each token, whatever their number: with d bits for each
    held level, false positives are about (1 - exp(-3 / d)) ** 3. It is cut into chunks for ``RANGE_TOKENS`` tokens, of those
    learnt from or of the ``probed`` ones if they are more; the chunks stay in a table."""
    ship_package(train.sparkSession)
    n = token_count(train, text)
    n_chunks = max(1, math.ceil(max(n, probed) / RANGE_TOKENS))
    chunk_bits = max(64, math.ceil(n * bits_per_token / n_chunks / 8) * 8)
    chunks = staged(_chunks(_by_chunk(_ngram_blocks(train, text, n_chunks), n_chunks), chunk_bits))
    distinct = chunks.agg(F.sum("distinct")).first()[0] or 0
    return Model(chunks.drop("distinct"), n_chunks, chunk_bits, n, distinct)


# --- scoring ------------------------------------------------------------------------------------------

_BLOCKS = "block string, ids array<long>, n_tokens array<long>, codes binary, cell long, asked_words binary, asked_pairs binary, word_cuts binary, pair_cuts binary"
_MODEL = {"chunk": "int", "bits": "binary", "words": "binary", "counts": "binary"}
_ANSWERS = "block string, ids array<long>, n_tokens array<long>, codes binary, cell long, asked_words binary, counts binary, word_levels binary, pair_levels binary"


def _block_rows(block: str, ids: list, tokens: list, lengths: list, bounds: np.ndarray, first: np.ndarray | None = None) -> Iterator[tuple]:
    """What the block keeps, which passes one of the parts, and what it asks of each part."""
    flat, length = np.concatenate(tokens), np.concatenate(lengths)
    keys, start = unigram_keys(flat), unigram_keys(np.array([START]))
    named, codes = np.unique(np.append(keys, start), return_inverse=True)
    pairs = np.unique(pair_keys(unigram_keys(histories(flat, np.concatenate([[0], np.cumsum(length)]))), keys))
    packed = pa.compress(planes(codes.astype(np.uint32)), "zstd", asbytes=True)
    first = first_chunks(len(bounds)) if first is None else first
    yield (block, [i for x in ids for i in x], length.tolist(), packed, zlib.crc32(block.encode()) % (len(first) - 1), None, None, None, None)
    asked = [{p: (low, cuts) for p, _, low, cuts in in_parts(x, bounds, first, width)} for x, width in ((named, WORD_BYTES), (pairs, PAIR_BYTES))]
    none = (b"", b"")
    for p in sorted(asked[0].keys() | asked[1].keys()):
        (words, word_cuts), (both, pair_cuts) = (side.get(p, none) for side in asked)
        yield (block, None, None, None, p, words, both, word_cuts, pair_cuts)


def score_documents(docs: DataFrame, train: Column, text: str = "text", bits_per_token: int = 6) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from the rows where ``train`` holds.

    Null texts are empty: their one token is the end. Repeated rows and ids are texts of their own, null ids stay null, other
    columns are ignored, an empty table gives no rows. Where no row is learned from, all tokens are unknown.

    A block of texts asks each part once for every distinct word and bigram that it has there, and gets back the words' exact
    counts and the levels that the filter holds; the texts are scored where these meet the block's tokens. A task holds the
    chunks of one part and a batch of what the blocks ask. Two of n distinct words have the same hash with a probability of
    n * n / 2**65.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), text)
    model = fit(rows.filter("train"), text, bits_per_token, probed=token_count(rows, text))
    n_chunks, chunk_bits, block_bytes = model.n_chunks, model.chunk_bits, BLOCK
    first = first_chunks(n_chunks)
    size_of_model, history_weight = model.train_tokens + 0.5 * (model.distinct + 1), model.weight

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, task, n = range_bounds(n_chunks), TaskContext.get().partitionId(), 0
        held: tuple[list, ...] = ([], [], [])
        size = 0
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), *[pa.binary()] * 4]
        names = ["block", "ids", "n_tokens", "codes", "cell", "asked_words", "asked_pairs", "word_cuts", "pair_cuts"]

        def flush() -> pa.RecordBatch:
            made = zip(*_block_rows(f"{task}-{n}", *held, bounds, first), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types, strict=True)], names)

        for batch in batches:
            for a, b, tokens, starts in batch_tokens(batch.column(text)):
                for kept, value in zip(held, (batch.column("doc_id").slice(a, b - a).to_pylist(), tokens, np.diff(starts)), strict=True):
                    kept.append(value)
                size += 8 * len(tokens)
                if size > block_bytes:
                    yield flush()
                    held, size, n = ([], [], []), 0, n + 1
        if size:
            yield flush()

    def opened(chunks: pa.Table) -> dict[int, tuple]:
        """(bits, words, counts) of the part's chunks."""
        columns = (chunks["bits"].to_pylist(), chunks["words"].to_pylist(), chunks["counts"].to_pylist())
        return {i: (np.frombuffer(b, np.uint8), np.append(np.frombuffer(w, np.uint64), np.uint64(0)), np.append(np.frombuffer(c, np.int64), 0))
                for i, b, w, c in zip(chunks["chunk"].to_pylist(), *columns, strict=True)}

    def by_chunk(cell: int, keys: np.ndarray, cuts: bytes) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        for i, n in enumerate(np.frombuffer(cuts, np.uint32).tolist()):
            if n:
                yield int(first[cell]) + i, keys[at:at + n]
            at += n

    def levels(chunks: dict[int, tuple], chunk: int, keys: np.ndarray) -> np.ndarray:
        return held_levels(chunks[chunk][0], keys, chunk_bits) if chunk in chunks else np.zeros(len(keys), np.uint8)

    def exact(chunks: dict[int, tuple], chunk: int, keys: np.ndarray) -> np.ndarray:
        if chunk not in chunks:
            return np.zeros(len(keys), np.int64)
        _, words, counts = chunks[chunk]
        at = np.searchsorted(words[:-1], keys)
        return np.where(words[at] == keys, counts[at], 0)

    def answers(chunks: dict[int, tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        out: list[list] = [[], [], []]
        asked = (batch.column(c).to_pylist() for c in ("cell", "asked_words", "asked_pairs", "word_cuts", "pair_cuts"))
        for cell, words, pairs, word_cuts, pair_cuts in zip(*asked, strict=True):
            if words is None:
                for to in out:
                    to.append(None)
                continue
            keys = list(by_chunk(cell, np.frombuffer(words, np.uint64), word_cuts))
            both = by_chunk(cell, unpacked([pairs], PAIR_BYTES), pair_cuts)
            out[0].append(planes(joined([exact(chunks, *x) for x in keys], np.int64)))
            out[1].append(joined([levels(chunks, *x) for x in keys], np.uint8).tobytes())
            out[2].append(joined([levels(chunks, *x) for x in both], np.uint8).tobytes())
        names = ["block", "ids", "n_tokens", "codes", "cell", "asked_words"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.binary()) for x in out)], [*names, "counts", "word_levels", "pair_levels"])

    def whole(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table["codes"]))
        parts = table.filter(pa.compute.is_valid(table["counts"])).sort_by("cell")
        ids, n_tokens = (head[c].combine_chunks().flatten() for c in ("ids", "n_tokens"))
        starts = np.concatenate([[0], np.cumsum(n_tokens.to_numpy())])
        joined = lambda name, kind: np.frombuffer(b"".join(parts[name].to_pylist()), kind)
        codes = from_planes(pa.decompress(head["codes"][0].as_py(), 4 * (int(starts[-1]) + 1), "zstd", asbytes=True), np.uint32)
        codes, before = codes[:-1], np.concatenate([codes[-1:], codes[:-2]])  # the last is START's
        before[starts[:-1]] = before[0]
        named = joined("asked_words", np.uint64)
        _, pair = np.unique(pair_keys(named[before], named[codes]), return_inverse=True)
        seen = np.concatenate([from_planes(x, np.int64) for x in parts["counts"].to_pylist()])
        single, both = middle(joined("word_levels", np.uint8)), middle(joined("pair_levels", np.uint8))[pair]
        word, history = single[codes], single[before]
        one = np.minimum(1.0, (word + 0.5) / size_of_model)
        weight = np.where(history > 0, history_weight, 0.0)
        p = weight * np.minimum(1.0, np.maximum(both - DISCOUNT, 0.0) / np.maximum(history, 1.0)) + (1 - weight) * one
        base = np.log10((seen + 0.5) / size_of_model)[codes]
        over = lambda values: pa.array(np.add.reduceat(values, starts[:-1]))
        return pa.table({"doc_id": ids, "n_tokens": n_tokens, "n_known": over((seen > 0)[codes].astype(np.int64)), "base_score": over(base), "score": over(np.log10(p))})

    given = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(blocks, _BLOCKS)
    asked = given.withColumns({"part": F.lit(0), **{c: F.lit(None).cast(t) for c, t in _MODEL.items()}})
    held = model.chunks.select(part_of(F.col("chunk"), n_chunks).alias("cell"), *_MODEL)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in asked.schema if f.name not in (*held.columns, "part")}
    answered = meet(held.withColumns({"part": F.lit(0), **missing}), asked, opened, answers, _ANSWERS, empty=True)
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    return answered.groupBy("block").applyInArrow(whole, out).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))
