"""Joins of large row sets with tables of few rows a key, where one key may hold a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitetide.session import cut_lineage

SALTS = 16
#: Rows of one key that stay in one task, and the most keys that are ever treated apart (one short row each).
HOT_ROWS, HOT_KEYS = 1 << 10, 1 << 16
#: Bytes of keys that are sent to all tasks, and what a key takes beside its text.
SENT_BYTES, KEY_BYTES = 1 << 24, 64


def join_dimension(
    rows: DataFrame, dimension: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join on ``keys`` where one key may hold a large share of ``rows``.

    Rows of one key are spread over ``salts`` partitions by a hash of ``spread``; the dimension, which has few
    rows per key, is repeated once per salt. When Spark finds the repeated dimension small enough to broadcast it
    does so and the salt costs nothing. It is repeated by a cross join, whose size Spark multiplies: an exploded list
    counts as one row and sends a large dimension, many times over, through the driver.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    repeated = dimension.crossJoin(F.broadcast(dimension.sparkSession.range(salts).withColumnRenamed("id", "_salt")))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_asked(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose text ``keys`` are in ``asked``, a written table.

    Where the keys asked for are few they are sent to the rows, so only rows that are wanted move afterwards. Left to itself Spark
    starts to shuffle both sides at once, wide rows included, before it knows how few keys there are.
    """
    text = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(k), F.lit(0)) for k in keys])
    size = asked.agg(F.coalesce(F.sum(text.cast("bigint") + KEY_BYTES), F.lit(0))).first()[0]
    wanted = asked.select(*keys).distinct()
    return rows.join(F.broadcast(wanted) if size <= SENT_BYTES else wanted, keys, "left_semi")


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, _salts) of the keys with more than ``hot_rows`` rows: into how many parts each is split; None if there are none.

    ``counts`` has one row a key, its number of rows in ``n``. The bound rises with the sum of the numbers where needed, so that
    there are never more than HOT_KEYS such keys: the table is small at every size.
    """
    total, most = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    bound = max(hot_rows, -(-total // HOT_KEYS))
    if most <= bound:
        return None
    return cut_lineage(counts.filter(F.col(n) > bound).select(*keys, F.ceil(F.col(n) / bound).alias("_salts")))


def join_hot(
    rows: DataFrame, dimension: DataFrame, keys: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join on ``keys``; only the keys that are hot in ``rows`` are split, each by its own size.

    Rows of a hot key go to one of its parts by a hash of ``spread``, the dimension's rows of that key to all of its parts;
    all other keys are joined as they are. In an outer join rows with a null key, which match nothing, are spread as well.
    ``rows`` is read twice, so it should be a written table; ``counts`` (keys, n) saves the first time.
    """
    if counts is None:
        counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, keys, hot_rows=hot_rows)
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]) if how == "left" else F.lit(False)
    part = F.xxhash64(*spread)
    if hot is None:
        if how != "left":
            return rows.join(dimension, keys, how)
        salted, repeated = rows.withColumn("_salts", F.lit(1)), dimension.withColumn("_salts", F.lit(1))
    else:
        salted, repeated = rows.join(F.broadcast(hot), keys, "left"), dimension.join(F.broadcast(hot), keys, "left")
    salts = F.coalesce("_salts", F.lit(1)).cast("bigint")
    salted = salted.withColumn("_salt", F.when(unmatched, F.pmod(part, F.lit(HOT_KEYS))).otherwise(F.pmod(part, salts))).drop("_salts")
    repeated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
