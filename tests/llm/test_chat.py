"""Chat formatting reads back as its source."""

import random

import pytest
from pyspark.sql import functions as F

from sitetide.llm import chat_format, queries
from sitetide.llm.queries import HARD_TEXT

PARTS = ["\\", "\\\\", "\\e", "\\h", "\\c", "</turn>", "</turn>\n", "### ", "#", "##", " ", ": ", ":", "\n", "user", "e", "h", "</tur", "n>", "é", "😀", "<"]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string, formatted string")


def unescaped_reader(formatted):
    """A reader written as a loop over characters."""
    turns, at = [], 0
    codes = {"\\": "\\", "e": "</turn>", "h": "### ", "c": ": "}

    def plain(s):
        out, i = "", 0
        while i < len(s):
            if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in codes:
                out, i = out + codes[s[i + 1]], i + 2
            else:
                out, i = out + s[i], i + 1
        return out

    while at < len(formatted):
        assert formatted.startswith("### ", at)
        end = formatted.index("</turn>", at)
        role, text = formatted[at + 4:end].split(": ", 1)
        assert formatted[end + 7] == "\n"
        turns.append((plain(role), plain(text)))
        at = end + 8
    return turns


def test_random_control_strings_come_back(spark):
    random.seed(3)
    mash = lambda n: "".join(random.choice(PARTS) for _ in range(random.randint(0, n)))
    rows = [(i % 40, i // 40, mash(3) if i % 3 else "assistant", mash(9), "x", "y") for i in range(600)]
    for row in chat_format.format_conversations(chats(spark, rows)).collect():
        source = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == row.conv_id), key=lambda r: (r[1], r[2], r[3]))]
        assert [tuple(t) for t in row.turns] == source == unescaped_reader(row.formatted)
        learned = [unescaped_reader(f"### a: {row.formatted[s.start:s.start + s.length]}</turn>\n")[0][1] for s in row.loss_spans]
        assert learned == [t for r, t in source if r == "assistant"]


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a \\ b: c", "x", "y"), (1, 1, "assistant", HARD_TEXT, "x", "y")]
    row = chat_format.format_conversations(chats(spark, rows)).first()
    assert row.formatted == "### user: a \\ b: c</turn>\n### assistant: \\\\\\hAssistant: \\e ok</turn>\n"


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, "x", "y"), (5, 1, "user", "b", "x", "y"), (5, 1, "user", "a", "x", "y"), (5, None, "user", "first", "x", "y"),
            (5, 1, "user", "a", "x", "y"), (6, 0, "assistant", "", "x", "y"), (7, 0, "user", "z" * 300_000, "x", "y")]
    got = {r.conv_id: r for r in chat_format.format_conversations(chats(spark, rows)).collect()}
    assert [t.text for t in got[5].turns] == ["first", "a", "a", "b"]
    assert [tuple(t) for t in got[None].turns] == [("", "")]
    assert [tuple(s) for s in got[6].loss_spans] == [(15, 0)] and got[7].loss_spans == []
    assert len(got[7].formatted) == 300_000 + 10 + 8
    assert chat_format.format_conversations(chats(spark, [])).count() == 0


def test_a_broken_text_has_no_turns(spark):
    broken = ["x", "### user: a", "### user: a</turn>", "### user</turn>\n", "### u: a ### b: c</turn>\n"]
    got = spark.createDataFrame([(b,) for b in broken], "t string").select(chat_format.parse(F.col("t")).alias("p")).collect()
    assert all(r.p is None or None in r.p for r in got)


@pytest.mark.parametrize("part", ["\\\\e", "\\", "### ### ", "</turn></turn>", "\\\\\\h"])
def test_escapes_reverse(spark, part):
    assert spark.range(1).select(chat_format.unescape(chat_format.escape(F.lit(part), role=True)).alias("x")).first().x == part


def test_the_query_reads_the_loss_mask(spark, monkeypatch):
    rows = [(r.conv_id, r.loss_chars) for r in queries.op10_chat_format(spark, "/root/testdata/sf0.001").collect()]
    assert sum(n for _, n in rows) > 0
    made = chat_format.format_conversations
    monkeypatch.setattr(chat_format, "format_conversations", lambda turns: made(turns).withColumn("loss_spans", F.slice("loss_spans", 1, 0)))
    assert all(r.loss_chars == 0 for r in queries.op10_chat_format(spark, "/root/testdata/sf0.001").collect())
