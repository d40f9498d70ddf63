"""Chat turns as one text, checked by reading it back.

Grammar of a formatted conversation::

    conversation = { "### " role ": " text "</turn>\\n" }

Role and text hold no control string (``### ``, ``</turn>``; roles no ``: `` either) but escapes: ``\\\\`` for a
backslash, ``\\h``, ``\\e`` and ``\\c`` for the control strings. A turn is first written as it is; if reading it back gives
something else, its role and text are escaped; what still differs is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, END, AFTER_ROLE = "### ", "</turn>", ": "
#: What is trained on.
LEARNED_ROLE = "assistant"


def escape(part: Column, role: bool = False) -> Column:
    out = F.replace(part, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit(END), F.lit("\\e")), F.lit(HEAD), F.lit("\\h"))
    return F.replace(out, F.lit(AFTER_ROLE), F.lit("\\c")) if role else out


def unescape(part: Column) -> Column:
    """The reverse of escape: pairs of backslashes are read from the left, the other escapes between them."""
    def between(piece: Column) -> Column:
        for code, control in (("\\e", END), ("\\h", HEAD), ("\\c", AFTER_ROLE)):
            piece = F.replace(piece, F.lit(code), F.lit(control))
        return piece
    plain = F.array_join(F.transform(F.split(part, r"\\\\", -1), between), "\\")
    return F.when(F.contains(part, F.lit("\\")), plain).otherwise(part)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(AFTER_ROLE), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>; a turn that breaks the grammar is null."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column, at: Column) -> Column:
        start = F.when(at == 0, F.lit(HEAD)).otherwise(F.lit("\n" + HEAD))
        rest = F.substring(piece, F.length(start) + F.lit(1), F.length(piece))
        role = F.substring_index(rest, AFTER_ROLE, 1)
        text = F.substring(rest, F.length(role) + F.lit(len(AFTER_ROLE) + 1), F.length(rest))
        fits = F.startswith(piece, start) & F.contains(rest, F.lit(AFTER_ROLE)) & ~F.contains(rest, F.lit(HEAD))
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    ends = F.element_at(pieces, -1) == "\n"
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    return F.when(formatted == "", F.slice(turns, 1, 0)).when(ends, turns)


def render_turns(turns: DataFrame) -> DataFrame:
    """The given rows (conv_id, turn, role, text; null role or text: empty) with ``rendered`` and ``body``, the text in it."""
    role, text = F.col("role"), F.col("text")
    known = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    plain = known.withColumns({"_plain": render(role, text)})
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    kept = plain.withColumn("_fits", F.coalesce(parse(F.col("_plain")) == source, F.lit(False)))
    written = kept.withColumns({
        "_role": F.when(F.col("_fits"), role).otherwise(escape(role, role=True)),
        "body": F.when(F.col("_fits"), text).otherwise(escape(text))})
    return written.select("conv_id", "turn", "role", "text", "_role", "body", render(F.col("_role"), F.col("body")).alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), loss_spans (start and length of learned text).

    Turns are in order of ``turn`` (nulls first), then role and text; repeated rows are turns of their own, a null conv_id is
    a conversation, null role or text is empty, other columns are ignored, an empty table gives no rows. Rendering,
    escaping and the first check are per row; one shuffle by conv_id brings the turns of a conversation together, since its
    text is one value. Characters are code points. Raises an error if a text doesn't read back as its source.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    row = render_turns(turns).withColumns({
        "_at": F.row_number().over(order),
        "_start": F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    start = F.col("_start") + F.length(F.concat(F.lit(HEAD), F.col("_role"), F.lit(AFTER_ROLE)))
    span = F.when(F.col("role") == LEARNED_ROLE, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    one = row.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_at", "rendered", "role", "text", span.alias("span")))).alias("_rows"))
    built = one.select(
        "conv_id", F.array_join(F.transform("_rows", lambda r: r["rendered"]), "").alias("formatted"),
        F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("_source"),
        F.filter(F.transform("_rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    ).withColumn("_read", parse(F.col("formatted")))
    checked = F.when(F.col("_read") == F.col("_source"), F.col("_read")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not read back as its source")))
    return built.select("conv_id", "formatted", checked.alias("turns"), "loss_spans")
