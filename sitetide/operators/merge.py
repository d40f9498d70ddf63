"""Keyed merge of a snapshot with a set of changes.

Parquet has no in-place update; the caller writes the result as a new snapshot.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Side:
    """The columns of one side of a merge by name; null where a side has no row."""

    def __init__(self, prefix: str | None) -> None:
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.lit(None) if self.prefix is None else F.col(f"`{self.prefix}{name}`")


Rule = Callable[[Any, Any], Column]


def merge_by_key(
    target: DataFrame,
    changes: DataFrame,
    keys: list[str],
    matched: dict[str, Rule] | None = None,
    inserted: dict[str, Rule] | None = None,
    insert: bool = True,
) -> DataFrame:
    """``target`` after ``changes``, which hold at most one row per key.

    ``matched`` and ``inserted`` map a column to ``rule(old, change)``. Without a rule a matched row keeps
    its old value and an inserted row takes the change's column of that name, or null.

    Rows of the target are updated by a left join with the changes, which Spark can broadcast when they are few; new keys
    are the changes that an anti join with the target's keys leaves. Columns stay plain, so unused ones are never read.
    """
    matched, inserted = matched or {}, inserted or {}
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changes.columns], F.lit(True).alias("_changed"))
    old_side, new_side = Side(""), Side("_new_")

    def updated(name: str) -> Column:
        if name in keys or name not in matched:
            return F.col(name)
        rule = matched[name](old_side, new_side).cast(target.schema[name].dataType)
        return F.when(F.col("_changed"), rule).otherwise(F.col(name)).alias(name)

    merged = target.join(new, keys, "left").select(*[updated(c) for c in target.columns])
    if not insert:
        return merged

    def fresh(name: str) -> Column:
        if name in keys:
            return F.col(name)
        given = F.col(f"`_new_{name}`") if name in changes.columns else F.lit(None)
        value = inserted[name](Side(None), new_side) if name in inserted else given
        return value.cast(target.schema[name].dataType).alias(name)

    added = new.join(target.select(*keys), keys, "left_anti").select(*[fresh(c) for c in target.columns])
    return merged.unionByName(added)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows whose key is not there yet (``rows`` hold at most one row per key)."""
    fresh = rows.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def take(name: str) -> Rule:
    return lambda old, new: new[name]
