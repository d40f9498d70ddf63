"""JSON at the boundary: encode lists and objects, decode leniently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitetide.functions.text import as_col, let


def to_json_col(col: Column | str) -> Column:
    return F.to_json(as_col(col))


def safe_json(**fields: Column) -> Column:
    """JSON object of the given fields, nulls written out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def variant_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_items(value: Column) -> Column:
    """String elements of a variant array; an empty list for anything else."""
    items = F.try_variant_get(value, "$", "array<variant>")
    strings = F.transform(
        F.filter(items, lambda v: variant_kind(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(strings, F.array().cast("array<string>"))


def json_string_array(col: Column | str) -> Column:
    """String elements of a JSON array text; an empty list when it is not one."""
    return let(F.try_parse_json(as_col(col)), string_items)


def json_or_raw(col: Column | str) -> Column:
    """Compact JSON when the text parses, else the text itself as a JSON string; null when empty."""
    text = F.nullif(as_col(col), F.lit(""))
    return let(
        F.try_parse_json(text),
        lambda v: F.when(text.isNull(), F.lit(None).cast("string"))
        .when(v.isNotNull(), F.to_json(v))
        .otherwise(F.get(F.split(F.to_json(F.array(text)), r"^\[|\]$"), F.lit(1))),
    )
