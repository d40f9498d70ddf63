"""Small tables for the corpus operators, and plain statements of what they should return."""

import re
from collections import defaultdict

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns that are named like results
    *[T.StructField(c, T.StringType()) for c in ("kept", "copy", "shard", "slot", "ids", "score", "n_tokens", "component_id", "_bucket", "decoded")],
])

PROSE = "The quick brown fox jumps over the lazy dog while a very old man looks on and counts his sheep in the evening sun"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))


def documents(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None, *["x"] * 10) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


#: Nulls, empty and very long texts, ties, repeated rows and ids, white space of all kinds.
ODD_ROWS = [
    (1, PROSE), (2, PROSE.replace(" ", "\t\n ")), (3, PROSE.replace("sheep", "cows")), (4, None), (5, ""), (6, " \t\n"), (7, "two words"),
    (8, "Two words"), (8, "Two words"), (9, LONG), (10, LONG + " end"), (11, "Äß İ ΣΣ é \U0001F600"), (12, "<|endoftext|>x</w>", None),
    (None, PROSE), (None, None, None), (13, "a a a a a a a a"), (14, "\x00\x1c\x85!"), (2, PROSE), (20, "### User: </turn> \\e", "src9"),
]


def tokens(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text):
    words = tokens(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near_groups(sets, threshold=85):
    """Smallest reachable id of each id, from {id: shingle set}, by counting shared shingles of all pairs."""
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}
