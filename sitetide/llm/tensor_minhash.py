"""Near duplicates: MinHash with tensored banding, every link confirmed on the full shingle sets.

Two collections of ``SIDE`` sub-signatures of ``HASHES`` minhashes each are computed for a document. A table's key is a pair
of one sub-signature from either collection: SIDE * SIDE tables from 2 * SIDE * HASHES minhashes. A pair of similarity s
misses all tables with a probability of about 2 * (1 - s ** HASHES) ** SIDE: 2e-5 for 0.80, 5e-7 for 0.85, less above.

Documents with equal shingle sets are one class and take part once. Pair after pair of a bucket would be quadratic, so links are
found in steps that stay exact: all members are compared with one leader; what that leaves in different components is
compared with a second leader, and further ones while they halve the rows that are left; the rest, in the buckets of one
collection alone, in blocks of bounded size. Pairs that are already connected need no comparison, as components don't change
by it. What reaches the blocks is quadratic in the members of a bucket that neither leader is similar to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetide.llm.common import batch_slices, handing_back, mix, staged, text_buffer, word_bounds, word_hashes
from sitetide.llm.components import components
from sitetide.operators.joins import join_hot
from sitetide.session import ship_package

SHINGLE = 5
SIDE, HASHES = 16, 3
#: Similarity from which documents are linked, in hundredths.
THRESHOLD = 85
#: Documents of a block when what leaders left is compared, rounds of leaders before that, and the share of rows that a
#: further round must leave at most.
BLOCK, LEADERS, SHRINKS = 512, 2, 0.5

_RANDOM = np.random.default_rng(73)
_MULTIPLIERS = _RANDOM.integers(0, 1 << 64, 2 * SIDE * HASHES, dtype=np.uint64) | np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 64, 2 * SIDE * HASHES, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 64, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending within the text, and where each text's begin.

    A shingle is five consecutive words; a text of fewer words is one shingle as a whole, one without words has none.
    """
    begin, end, first = word_bounds(raw, starts)
    words, n = word_hashes(raw, begin, end), np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    head = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    length = np.minimum(n[text], SHINGLE)
    value = length.astype(np.uint64) * _PLACES[SHINGLE]
    for i in range(SHINGLE):
        has = i < length
        value[has] += words[head[has] + i] * _PLACES[i]
    value = mix(value)
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.uint16) if len(n) < 1 << 16 else text[order], kind="stable")]
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def sub_signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 2 * SIDE sub-signatures of each non-empty set."""
    out = np.zeros((len(starts) - 1, 2 * SIDE), dtype=np.uint64)
    for i in range(2 * SIDE * HASHES):
        least = np.minimum.reduceat((sets ^ _MASKS[i]) * _MULTIPLIERS[i], starts[:-1])
        out[:, i // HASHES] = mix(out[:, i // HASHES] + least + np.uint64(i + 1))
    return out


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit digest of the set; null if empty), subs (sub-signatures; null if empty)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffer(batch.column(text))
            for a, b in batch_slices(starts):
                sets, at = shingle_sets(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
                n = np.diff(at)
                full = np.flatnonzero(n)
                first = np.append(at[:-1][full], len(sets))
                names, subs = np.zeros((2, len(n)), np.uint64), np.zeros((0, 2 * SIDE), np.uint64)
                if len(full):
                    digests = [hashlib.blake2b(sets[i:j], digest_size=16).digest() for i, j in zip(first[:-1], first[1:], strict=True)]
                    names[:, full] = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
                    subs = sub_signatures(sets, first)
                none = n == 0
                sizes = np.concatenate([[0], np.cumsum((n > 0) * 2 * SIDE)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(subs.ravel().view(np.int64)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()),
                    *[pa.array(row.view(np.int64), mask=none) for row in names], lists], ["doc_id", "n_shingles", "set_a", "set_b", "subs"])

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")],
                           T.StructField("subs", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", text).mapInArrow(handing_back(run), schema)


def tensor_buckets(reps: DataFrame) -> DataFrame:
    """(key, rep): the tables' buckets that hold two documents or more, from (rep, subs).

    A table's key occurs twice only if both its sub-signatures do, so those are counted first and the rest never combined.
    """
    single = reps.select("rep", F.posexplode("subs").alias("place", "sub"))
    twice = single.groupBy("place", "sub").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("place", "sub")
    found = single.join(twice, ["place", "sub"]).groupBy("rep").agg(F.collect_set(F.struct("place", "sub")).alias("subs"))
    one, two = F.filter("subs", lambda s: s["place"] < SIDE), F.filter("subs", lambda s: s["place"] >= SIDE)
    pairs = F.flatten(F.transform(one, lambda x: F.transform(two, lambda y: F.xxhash64(x["place"], x["sub"], y["place"], y["sub"]))))
    keyed = staged(found.select("rep", F.explode(pairs).alias("key")))
    return shared(keyed, "rep")


def shared(rows: DataFrame, column: str) -> DataFrame:
    """The rows (a written table) of keys that hold two different values of the column. Keys are combined before the shuffle, and
    hot ones split in the join."""
    ends = rows.groupBy("key").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"))
    kept = staged(ends.filter("low < high").select("key", "n"))
    return join_hot(rows, kept.select("key"), ["key"], ["rep"], counts=kept)


def one_side(reps: DataFrame, rest: DataFrame) -> DataFrame:
    """(key, rep, component) of the buckets that the first collection alone makes for the documents in ``rest``.

    Whatever shares a table's bucket shares its sub-signature of the first collection: these SIDE tables hold all pairs that
    are left in SIDE * SIDE, in far fewer rows."""
    left = rest.select("rep", "component").distinct()
    single = reps.join(left, "rep").select("rep", "component", F.posexplode("subs").alias("place", "sub")).filter(F.col("place") < SIDE)
    return shared(staged(single.select(F.xxhash64("place", "sub").alias("key"), "rep", "component")), "component")


def similar(shared_: np.ndarray | int, n_a: np.ndarray | int, n_b: np.ndarray | int, threshold: int) -> np.ndarray | bool:
    return 100 * shared_ >= threshold * (n_a + n_b - shared_)


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts: (rep, text)."""
    one, two = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            sides = [_sets(batch.column(c), k) for c, k in (("text_a", a), ("text_b", b))]
            links = []
            for i in range(len(a)):
                x, y = sides[0][i], sides[1][i]
                if 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    if similar(both, len(x), len(y), threshold):
                        links.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(handing_back(run), "a long, b long")


def _sets(texts: pa.Array, ids: np.ndarray) -> list[np.ndarray]:
    """The shingle set of each row; consecutive rows of one id share it."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    raw, starts = text_buffer(texts.filter(pa.array(new)))
    sets: list[np.ndarray] = []
    for a, b in batch_slices(starts):
        values, at = shingle_sets(raw[starts[a]:starts[b]], starts[a:b + 1] - starts[a])
        sets += [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return [sets[i] for i in np.cumsum(new) - 1]


def block_links(rest: DataFrame, texts: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Links between the components that share a bucket, from rows (key, rep, component); enough of them to connect all that
    are similar.

    A bucket's rows are dealt into blocks of about ``block``: a large component fills blocks of its own, smaller ones share.
    Every two blocks that hold different components meet in one group of at most two blocks; no group grows with the bucket.
    """
    size = staged(rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")))
    small = F.col("n") < block
    totals = staged(size.groupBy("key").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("n_small"), F.sum("n").alias("n")))
    own_blocks, small_blocks = F.ceil(F.col("n") / block), F.greatest(F.ceil(F.col("n_small") / block), F.lit(1))
    sized = join_hot(rest, size, ["key", "component"], ["rep"], counts=size)
    placed = join_hot(sized, totals.drop("n"), ["key"], ["rep"], counts=totals).select(
        "key", "rep", "component",
        F.when(small, F.lit(None).cast("long")).otherwise(F.col("component")).alias("owner"),
        F.when(small, F.pmod(F.xxhash64("rep"), small_blocks)).otherwise(F.pmod(F.xxhash64("rep"), own_blocks)).alias("part"))
    blocks = placed.select("key", "owner", "part").distinct()
    left = blocks.select("key", F.struct("owner", "part").alias("x"))
    right = blocks.select("key", F.struct("owner", "part").alias("y"))
    met = left.join(right, "key").filter("x <= y AND (x.owner IS NULL OR y.owner IS NULL OR x.owner <> y.owner)").select(
        "key", "x", "y", F.xxhash64("key", "x", "y").alias("pair"))
    ends = met.select("key", "pair", "x.owner", "x.part").union(met.filter("NOT x <=> y").select("key", "pair", "y.owner", "y.part"))
    same = (F.col("p.key") == F.col("e.key")) & F.col("p.owner").eqNullSafe(F.col("e.owner")) & (F.col("p.part") == F.col("e.part"))
    rows = placed.alias("p").join(ends.alias("e"), same).select("e.pair", "p.rep", "p.component").join(texts, "rep")

    def run(table: pa.Table) -> pa.Table:
        ids, component = table["rep"].to_numpy(), table["component"].to_numpy()
        raw, starts = text_buffer(table["text"].combine_chunks())
        links = linked_blocks(ids, component, *shingle_sets(raw, starts), threshold)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.select("pair", "rep", "component", "text").groupBy("pair").applyInArrow(run, "a long, b long")


def linked_blocks(ids: np.ndarray, component: np.ndarray, sets: np.ndarray, starts: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Similar pairs of different components, each of which joins two components that were apart so far."""
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    _, code, times = np.unique(sets, return_inverse=True, return_counts=True)
    several = times[code] > 1
    doc, code = doc[several], np.cumsum(times > 1)[code[several]] - 1
    width = int(code.max()) // 8 + 1 if len(code) else 1
    bits = np.zeros((len(n), width), dtype=np.uint8)
    np.bitwise_or.at(bits, (doc, code >> 3), np.left_shift(1, code & 7).astype(np.uint8))
    group = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while group[c] != c:
            group[c] = c = group[group[c]]
        return c

    links = []
    for i in range(len(n) - 1):
        others = np.flatnonzero((component[i + 1:] != component[i]) & (100 * np.minimum(n[i + 1:], n[i]) >= threshold * np.maximum(n[i + 1:], n[i]))) + i + 1
        if len(others):
            both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in others[similar(both, n[i], n[others], threshold)].tolist():
                x, y = top(int(component[i])), top(int(component[j]))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    links.append((int(ids[i]), int(ids[j])))
    return links


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents are linked if the shared shingles are ``threshold`` hundredths of all their shingles or more. Null and empty
    texts have no shingles and are linked with nothing. Rows that share a doc_id are one document, linked where any of its
    texts is (a repeated id's empty text stays by itself); rows with a null doc_id are documents of their own, kept and in
    no component (null). Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = staged(sketches(docs))
    full = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    classed = staged(full.join(classes, ["set_a", "set_b"]).select(
        "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("subs")).alias("subs")))
    several = classed.groupBy(F.col("doc_id").alias("key")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    found = [classed.select(F.col("doc_id").alias("key"), "rep").join(several, "key").select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct()]

    reps = classed.filter(F.col("subs").isNotNull()).select("rep", "subs").distinct()
    buckets = staged(tensor_buckets(reps))
    wanted = buckets.select("rep").distinct()
    texts = staged(docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi"))
    rest = buckets.withColumn("component", F.col("rep"))
    labels = None
    before, n_rest = None, buckets.count()
    while n_rest and (before is None or len(found) <= LEADERS or n_rest <= SHRINKS * before):
        leaders = rest.groupBy("key").agg(F.min(F.struct("rep", "component")).alias("leader"))
        led = staged(join_hot(rest, leaders, ["key"], ["rep"]))
        pairs = led.filter("component <> leader.component").select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()
        found.append(staged(confirm(pairs, texts, threshold)))
        labels = components(_union(found))
        left = led.filter("rep <> leader.rep").select("key", "rep")
        rest = staged(shared(staged(_labelled(left, labels, "rep")), "component").select("key", "rep", "component"))
        before, n_rest = n_rest, rest.count()
    if before is None:
        labels = components(found[0])
    if n_rest:
        found.append(staged(block_links(staged(one_side(reps, rest)), texts, threshold)))
        labels = components(_union(found))
    by_rep = _labelled(classed.select("doc_id", "n_shingles", "rep"), labels, "rep")
    empty = sketched.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    rows = by_rep.select("doc_id", "n_shingles", "component").union(empty)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """The rows with the component of the node in ``column``; a node without links is its own."""
    known = labels.withColumnRenamed("node", column)
    label: Column = F.coalesce("_component", column)
    return rows.drop("component").join(known.withColumnRenamed("component", "_component"), column, "left").withColumn("component", label).drop("_component")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the documents that have a smaller doc_id in their component."""
    dropped = near_duplicates(docs, threshold).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
