"""Sources mixed to target weights by Poisson replication, then shuffled globally."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.llm.common import lookup, text_or_empty

#: Name of the pool of all sources without a weight of their own.
OTHERS = None
#: A larger mean is drawn in equal parts, each by its own hash: sums of Poisson counts are Poisson again.
LARGEST_MEAN = 8.0
#: Draws are whole numbers below this.
DRAWS = 1 << 52
#: Copies of one document that one task makes.
CHUNK = 1 << 10


def hashed(seed: int, *columns: Column, digits: int = 13) -> Column:
    """A whole number of ``digits`` hexadecimal digits from a seeded hash; a null counts as the word null."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, digits), 16, 10).cast("long")


def _pooled(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """docs with _pool: the source if it has a weight, else null."""
    known = docs.sparkSession.createDataFrame([(k,) for k in weights], "_pool string")
    return docs.join(lookup(known, len(weights)), docs["source"] == known["_pool"], "left")


def repetition_rates(docs: DataFrame, weights: dict[str, float], other_weight: float, epochs: float) -> dict[str | None, float]:
    """Mean repetitions by source (None: all sources without a weight), so that output bytes follow the weights.

    ``weights`` is a parameter: one sum for each of its entries reaches the driver. Weights of sources without bytes go to
    the others in proportion; documents of a source without any bytes repeat ``epochs`` times.
    """
    n_bytes = docs.select("source", F.octet_length(text_or_empty()).cast("long").alias("_n"))
    sums = _pooled(n_bytes, weights).groupBy("_pool").agg(F.sum("_n").alias("n")).collect()
    size = {row["_pool"]: row["n"] or 0 for row in sums}
    wanted = {k: (other_weight if k is OTHERS else weights[k]) for k in size}
    share = sum(w for k, w in wanted.items() if size[k]) or 1.0
    total = sum(size.values())
    return {k: epochs * wanted[k] / share * total / size[k] if size[k] else epochs for k in size}


def poisson_table(mean: float) -> list[int]:
    """Upper bounds of the draws that give 0, 1, 2, ... : the distribution function times DRAWS."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        out.append(min(DRAWS, math.floor(total * DRAWS)))
        k += 1
        term *= mean / k
        if term * DRAWS < 0.25 and k > mean:
            return out


def drawn(seed: int) -> Column:
    """How often a document occurs, from _parts and _bounds: an inverted Poisson distribution at a hash of seed and doc_id.

    A large mean is drawn in _parts equal parts, each by its own hash."""

    def one(part: Column) -> Column:
        at = hashed(seed, F.col("doc_id"), part)
        return F.size(F.filter("_bounds", lambda bound: bound <= at)).cast("long")

    several = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), F.lit(0).cast("long"), lambda total, part: total + one(part))
    return F.when(F.col("_parts") == 1, one(F.lit(0))).otherwise(several)


def counted(docs: DataFrame, rates: dict[str | None, float], weights: dict[str, float], seed: int) -> DataFrame:
    """docs with n_copies, without those that have none. A source's draws are a row of a table, so any number of sources
    makes the same expression; documents meet their row by a join."""
    rows = []
    for pool, rate in rates.items():
        if rate > 0:
            parts = max(1, math.ceil(rate / LARGEST_MEAN))
            rows.append((pool, parts, poisson_table(rate / parts)))
    table = docs.sparkSession.createDataFrame(rows, "_of string, _parts long, _bounds array<long>")
    pooled = _pooled(docs, weights)
    met = pooled.join(lookup(table, len(rows)), pooled["_pool"].eqNullSafe(table["_of"]))
    return met.withColumn("n_copies", drawn(seed)).filter(F.col("n_copies") > 0).drop("_pool", "_of", "_parts", "_bounds")


def repeated(docs: DataFrame) -> DataFrame:
    """A row with copy (from 1) for each of the n_copies; what occurs very often is first dealt out in chunks of copies."""
    number = F.sequence(F.lit(1).cast("long"), F.col("n_copies"))
    often = docs.filter(F.col("n_copies") > CHUNK).withColumn(
        "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1, F.lit(CHUNK).cast("long"))))
    dealt = often.repartition("doc_id", "_first")
    some = F.sequence(F.col("_first") + 1, F.least(F.col("_first") + CHUNK, F.col("n_copies")))
    return docs.filter(F.col("n_copies") <= CHUNK).withColumn("copy", F.explode(number)).unionByName(
        dealt.withColumn("copy", F.explode(some)).drop("_first"))


def mix_sources(docs: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, seed: int = 29) -> DataFrame:
    """The columns of ``docs``, n_copies, copy (from 1) and shuffle_key; documents as often as their source's target asks.

    The target of a source is its weight's share of ``epochs`` times all bytes; sources without a weight share ``other_weight``,
    a null source is one of them. Rows with equal doc_id get equal counts; null ids draw as one id; null and empty texts have no
    bytes and repeat like the rest of their source; columns named like the added ones are replaced; an empty table gives no rows.

    The global shuffle deals the rows by shuffle_key, a hash of doc_id and copy, and sorts each partition by it: a third of all
    rows in one source spreads evenly, nothing is sampled and no task sees more than its share.
    """
    docs = docs.drop("n_copies", "copy", "shuffle_key", "_pool", "_of", "_parts", "_bounds", "_first")
    rates = repetition_rates(docs, weights, other_weight, epochs)
    keyed = repeated(counted(docs, rates, weights, seed)).withColumn("shuffle_key", hashed(seed + 1, F.col("doc_id"), F.col("copy"), digits=15))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
