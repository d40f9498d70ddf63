"""Schema and input rules as a violations table, with one pass per table for the row rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import trim_ws
from sitetide.functions.urls import canonical_url, same_host
from sitetide.operators.joins import HOT_KEYS, join_hot
from sitetide.schemas import ENUMS, FOREIGN_KEYS, PRIMARY_KEYS, TABLES, UNIQUE_KEYS
from sitetide.session import cut_lineage

Rules = dict[str, Column]


def row_rules(table: str) -> Rules:
    """Rule name to the condition a valid row meets."""
    rules: Rules = {}
    for field in TABLES[table].fields:
        if not field.nullable:
            rules[f"not_null:{field.name}"] = F.col(field.name).isNotNull()
    for (owner, column), values in ENUMS.items():
        if owner == table:
            rules[f"enum:{column}"] = F.col(column).isNull() | F.col(column).isin(values)
    if table == "page_analyses":
        rules["range:confidence"] = F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)
    return rules


def check_inputs(df: DataFrame, rules: Rules, key: Column) -> DataFrame:
    """(rule, key) of every broken rule; rows are scanned once whatever the number of rules."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda v: v.isNotNull())
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def _broken_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, the columns of df) of every broken rule; rows that keep all rules are left out before anything is built from them."""
    breaks = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()}
    names = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in breaks.items()]), lambda v: v.isNotNull())
    return df.filter(reduce(lambda x, y: x | y, breaks.values())).select("*", F.explode(names).alias("rule"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key) of all violations of the declared schema in the given tables.

    No row is written down: the row rules are a filter, and each key and each reference is counted from its own columns, summed
    up before they move. Of the references only the distinct ones meet the ids: a parent that a third of all rows name is
    one row by then. Those that are missing find their rows again; few are sent to all rows, with many the hot ones are split.
    Each table is read for the row rules, for every key and for every reference, so it should be a stored one.
    """
    found, counted, references, ids, place = [], [], [], [], ["target", "value"]
    parents = {parent for (owner, _), parent in FOREIGN_KEYS.items() if owner in tables}
    for name, df in tables.items():
        table, key = F.lit(name).alias("table"), F.concat_ws("|", *[F.col(k) for k in PRIMARY_KEYS[name]]).alias("key")
        found.append(_broken_rows(df, row_rules(name)).select(table, "rule", key))
        for keys, condition in [(PRIMARY_KEYS[name], None), *UNIQUE_KEYS.get(name, [])]:
            repeated = (df.filter(condition) if condition else df).groupBy(*keys).count().filter("count > 1")
            found.append(repeated.select(table, F.lit("unique:" + ",".join(keys)).alias("rule"), F.concat_ws("|", *keys).alias("key")))
        if name in parents:
            ids.append(df.select(F.lit(name).alias("target"), F.col("id").alias("value")))
        for (owner, column), parent in FOREIGN_KEYS.items():
            if owner == name and parent in tables:
                named = df.filter(F.col(column).isNotNull())
                to = [F.lit(parent).alias("target"), F.col(column).alias("value")]
                counted.append(named.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(*to, "n"))
                references.append(named.select(table, F.lit(f"foreign_key:{column}").alias("rule"), key, *to))
    if references:
        missing = cut_lineage(_union(counted).groupBy(*place).agg(F.sum("n").alias("n")).join(_union(ids), place, "left_anti"))
        if missing.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
            lost = _union(references).join(F.broadcast(missing.drop("n")), place)
        else:
            lost = join_hot(_union(references), missing.drop("n"), place, ["key"], counts=missing)
        found.append(lost.select("table", "rule", "key"))
    return _union(found)


def _length(column: str, low: int, high: int) -> Column:
    return F.length(trim_ws(column)).between(low, high)


def _at_most(column: str, high: int, trimmed: bool = False) -> Column:
    text = trim_ws(column) if trimmed else F.col(column)
    return F.col(column).isNull() | (F.length(text) <= high)


def competitor_rules() -> Rules:
    return {
        "length:name": _length("name", 1, 100),
        "length:domain": _length("domain", 1, 253),
        "size:sitemap_urls": F.col("sitemap_urls").isNull() | (F.size("sitemap_urls") <= 10),
        "url:sitemap_urls": F.col("sitemap_urls").isNull()
        | F.forall("sitemap_urls", lambda u: canonical_url(u).isNotNull()),
    }


def list_filter_rules() -> Rules:
    ids = ["competitor_id", "page_type", "search_intent", "review_status"]
    return {f"length:{c}": _at_most(c, 100) for c in ids} | {
        "length:query": _at_most("query", 500, trimmed=True),
        "range:page": F.col("page").isNull() | F.col("page").between(1, 10_000),
        "range:page_size": F.col("page_size").isNull() | F.col("page_size").between(1, 100),
    }


def review_rules() -> Rules:
    return {
        "length:page_id": F.length("page_id").between(1, 100),
        "enum:review_status": F.col("review_status").isin(ENUMS["page_review", "review_status"]),
        "not_null:is_viewed": F.col("is_viewed").isNotNull(),
        "not_null:is_worth_following": F.col("is_worth_following").isNotNull(),
        "length:manual_page_type": _at_most("manual_page_type", 100, trimmed=True),
        "length:manual_primary_keyword": _at_most("manual_primary_keyword", 300, trimmed=True),
        "size:manual_secondary_keywords": F.size("manual_secondary_keywords") <= 20,
        "length:manual_secondary_keywords": F.forall(
            "manual_secondary_keywords", lambda k: F.length(trim_ws(k)).between(1, 300)),
        "length:manual_search_intent": _at_most("manual_search_intent", 100, trimmed=True),
        "length:notes": _at_most("notes", 5_000, trimmed=True),
    }


def check_sitemap_hosts(df: DataFrame) -> DataFrame:
    """Append ``ok``: every configured sitemap URL lies within the competitor domain."""
    return df.withColumn(
        "ok", F.forall("sitemap_urls", lambda u: F.coalesce(same_host(u, F.col("domain")), F.lit(False))))
