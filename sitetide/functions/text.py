"""Text, hash, id and CSV column expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a browser regular expression counts as white space.
WHITESPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# The same set beyond ASCII, one by one.
WIDE_SPACES = "".join(
    chr(c) for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])

EXCERPT_CHARS = 8_000
RAW_RESPONSE_CHARS = 4_000
ERROR_SUMMARY_CHARS = 4_000
ANALYSIS_ERROR_CHARS = 2_000


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply_sql(value: Column, body: str) -> Column:
    """``let`` with the body given as SQL lambda text: one parsed expression instead of many small ones."""
    return F.get(F.call_function("transform", F.array(value), F.expr(body)), F.lit(0))


def trim_ws(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def collapse_ws(col: Column | str) -> Column:
    """Runs of white space become one space, none at the ends.

    The rare wide code points are mapped to spaces first, so the regular expression is a plain ASCII one.
    """
    narrow = F.translate(as_col(col), WIDE_SPACES, " " * len(WIDE_SPACES))
    return F.trim(F.regexp_replace(narrow, r"[ \t-\r]+", " "))


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(as_col(col), F.lit(""))


def empty_to_null(col: Column | str) -> Column:
    """Trimmed text, null when nothing is left."""
    return blank_to_null(trim_ws(col))


def clip(col: Column | str, n: int | None) -> Column:
    """The first ``n`` characters; all without a number."""
    return as_col(col) if n is None else F.substring(as_col(col), 1, n)


def array_top(col: Column | str, n: int | None) -> Column:
    """The first ``n`` items; all without a number."""
    return as_col(col) if n is None else F.slice(as_col(col), 1, n)


def content_hash(col: Column | str) -> Column:
    return F.sha2(as_col(col), 256)


def make_id(prefix: str, *keys: Column | str) -> Column:
    """Deterministic entity id: the same natural key gives the same id on every retry."""
    parts = [F.coalesce(as_col(k).cast("string"), F.lit("\u0000")) for k in keys]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32))


def csv_cell(col: Column | str) -> Column:
    """Quoted cell; text a spreadsheet would run as a formula gets a leading apostrophe."""
    value = as_col(col)
    safe = F.when(value.rlike(rf"^[{WHITESPACE}]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def effective(manual: Column | str, inferred: Column | str) -> Column:
    """A non-empty manual value wins over the inferred one."""
    return F.coalesce(blank_to_null(manual), as_col(inferred))


def error_line(url: Column | str, message: Column | str, code: Column | str) -> Column:
    return F.concat(as_col(url), F.lit(": "), F.coalesce(as_col(message), as_col(code), F.lit("failed")))


def ascii_lower(col: Column | str) -> Column:
    return F.translate(as_col(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_pattern(col: Column | str, query: str) -> Column:
    """``LIKE '%query%'`` folding ASCII case only; ``%`` and ``_`` act as wildcards, no escape."""
    lowered = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in query.strip())
    pattern = "%" + lowered.replace("\\", "\\\\") + "%"
    return ascii_lower(col).like(pattern)
