"""Licence texts found by templates with optional and replaceable regions, compiled into one token automaton.

A template is licence wording with markup::

    <<beginOptional>> ... <<endOptional>>          may be there or not; may be nested
    <<var;name="holder";match=".+">>               replaceable: one to WIDEST words; ".*" also none, ".{2,9}" so many
    <<var;name="verb";match="released|licensed">>  replaceable: one of these wordings

Everything else is mandatory: its words must stand in the text one after the other, whatever is between the words. All
templates become one automaton over words. A text's words are looked up in the automaton's vocabulary (byte by byte, no
hashes), and all places of a slice of texts where some template can begin advance together, a word a step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitetide.llm.common import LOWER, batch_slices, text_buffer, word_bounds
from sitetide.session import ship_package

#: Most words of a replaceable region without a stated number.
WIDEST = 40
#: Regular expression of a word, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places that advance together.
_STARTS = 1 << 16

_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

# --- templates -----------------------------------------------------------------------------------------

Node = tuple  # ("word", w), ("optional", nodes), ("choice", [words, ...]) or ("gap", least, most)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(_ASCII_LOWER))


def parse(template: str) -> list[Node]:
    """The template's regions in order."""
    stack: list[list[Node]] = [[]]
    for piece in re.split(r"(<<.*?>>)", template, flags=re.S):
        if not piece.startswith("<<"):
            stack[-1] += [("word", w) for w in words_of(piece)]
        elif piece == "<<beginOptional>>":
            stack.append([])
        elif piece == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            region = stack.pop()
            stack[-1].append(("optional", region))
        else:
            match = re.search(r'match="([^"]*)"', piece)
            if match is None:
                raise ValueError(f"no match in {piece}")
            stack[-1].append(_replaceable(match[1]))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


def _replaceable(match: str) -> Node:
    bounds = {".+": (1, WIDEST), ".*": (0, WIDEST)}.get(match)
    if bounds is None and (numbers := re.fullmatch(r"\.\{(\d+),(\d+)\}", match)):
        bounds = int(numbers[1]), int(numbers[2])
    return ("gap", *bounds) if bounds else ("choice", [words_of(x) for x in match.split("|")])


def mandatory_words(nodes: list[Node]) -> int:
    return sum(node[0] == "word" for node in nodes)


def pattern(nodes: list[Node]) -> str:
    """The same wording as a regular expression over words that each end with a space."""
    out = []
    for kind, *rest in nodes:
        if kind == "word":
            out.append(rest[0] + " ")
        elif kind == "optional":
            out.append(f"(?:{pattern(rest[0])})?")
        elif kind == "choice":
            out.append("(?:" + "|".join("".join(w + " " for w in x) for x in rest[0]) + ")")
        else:
            out.append(f"(?:[^ ]+ ){{{rest[0]},{rest[1]}}}")
    return "".join(out)


# --- automaton -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """States without empty steps. Edges are sorted by (state, word); ``free`` edges take any word."""

    labels: list[str]
    weights: np.ndarray  # mandatory words of each label's wording
    vocabulary: list[bytes]
    keys: np.ndarray  # state * len(vocabulary) + word
    targets: np.ndarray
    free_states: np.ndarray
    free_targets: np.ndarray
    accepts: np.ndarray  # state, ascending, of each acceptance
    accepted: np.ndarray  # and its label
    first: int
    states: int


def compiled(templates: Mapping[str, str]) -> Automaton:
    empty: list[list[int]] = []
    steps: list[list[tuple[str | None, int]]] = []

    def state() -> int:
        empty.append([])
        steps.append([])
        return len(empty) - 1

    def chain(at: int, words: list[str | None]) -> int:
        for w in words:
            to = state()
            steps[at].append((w, to))
            at = to
        return at

    def add(at: int, nodes: list[Node]) -> int:
        for kind, *rest in nodes:
            if kind == "word":
                at = chain(at, [rest[0]])
                continue
            end = state()
            if kind == "optional":
                empty[at].append(end)
                empty[add(at, rest[0])].append(end)
            elif kind == "choice":
                for words in rest[0]:
                    empty[chain(at, words)].append(end)
            else:
                least, most = rest
                for n in range(most + 1):
                    if n >= least:
                        empty[at].append(end)
                    if n < most:
                        at = chain(at, [None])
            at = end
        return at

    first = state()
    labels, weights, final = list(templates), [], {}
    for number, template in enumerate(templates.values()):
        nodes = parse(template)
        if not mandatory_words(nodes):
            raise ValueError(f"{labels[number]} has no mandatory words")
        weights.append(mandatory_words(nodes))
        begin = state()
        empty[first].append(begin)
        final[add(begin, nodes)] = number

    def closure(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for to in empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    vocabulary = sorted({w for out in steps for w, _ in out if w is not None})
    code = {w: i for i, w in enumerate(vocabulary)}
    edges, free, accepts = set(), set(), set()
    for s in {first} | {to for out in steps for _, to in out}:
        for q in closure(s):
            edges |= {(s * len(code) + code[w], to) for w, to in steps[q] if w is not None}
            free |= {(s, to) for w, to in steps[q] if w is None}
            accepts |= {(s, final[q])} if q in final else set()
    columns = [np.array(sorted(x), np.int64).reshape(-1, 2) for x in (edges, free, accepts)]
    return Automaton(labels, np.array(weights, np.int64), [w.encode() for w in vocabulary], *(c[:, i] for c in columns for i in (0, 1)), first, len(empty))


def _matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all places j of the sorted keys that hold wanted[i]."""
    low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
    n = high - low
    i = np.repeat(np.arange(len(wanted)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]


def word_codes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """The place of each word in the vocabulary, or -1; compared byte by byte with A-Z in lower case."""
    codes, lengths = np.full(len(begin), -1, np.int64), end - begin
    for n in sorted({len(w) for w in vocabulary}):
        which = np.flatnonzero(lengths == n)
        if not len(which):
            continue
        own = np.array([i for i, w in enumerate(vocabulary) if len(w) == n])
        known = np.array([vocabulary[i] for i in own], f"S{n}")  # ascending, as the vocabulary is
        given = np.ascontiguousarray(LOWER[raw[begin[which][:, None] + np.arange(n)]]).view(f"S{n}").ravel()
        at = np.minimum(np.searchsorted(known, given), len(known) - 1)
        same = known[at] == given
        codes[which[same]] = own[at[same]]
    return codes


def places(machine: Automaton, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, label) of all accepted places, words of all texts numbered on; ``first``: number of each text's first word.

    A place is the longest from its start; one inside another of the same label is left out. Order: label, start.
    """
    n_words, size = len(codes), max(1, len(machine.vocabulary))
    limit = np.repeat(first[1:], np.diff(first))  # where a word's text ends
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    opening = np.unique(machine.keys[(machine.keys // size) == machine.first] % size)
    begins = np.flatnonzero(np.isin(codes, opening))
    if (machine.free_states == machine.first).any():
        begins = np.arange(n_words)
    for at in range(0, len(begins), _STARTS):
        start = begins[at:at + _STARTS]
        state, step = np.full(len(start), machine.first), 0
        while len(start):
            here = start + step
            inside = here < limit[start]
            start, state, here = start[inside], state[inside], here[inside]
            word = codes[here]
            known = np.flatnonzero(word >= 0)
            i, j = _matches(machine.keys, state[known] * size + word[known])
            k, m = _matches(machine.free_states, state)
            reached = [start[known[i]] * machine.states + machine.targets[j], start[k] * machine.states + machine.free_targets[m]]
            start, state = np.divmod(np.unique(np.concatenate(reached)), machine.states)
            step += 1
            a, b = _matches(machine.accepts, state)
            if len(a):
                found.append((start[a], start[a] + step, machine.accepted[b]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, end, label = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-end, start, label))
    start, end, label = start[order], end[order], label[order]
    furthest = np.maximum.accumulate(label * (n_words + 1) + end)  # ends of a smaller label are smaller
    new = np.ones(len(start), dtype=bool)
    new[1:] = label[1:] * (n_words + 1) + end[1:] > furthest[:-1]
    return start[new], end[new], label[new]


PLACE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())]))


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str], templates: Mapping[str, str], text: str = "text") -> DataFrame:
    """doc_id, n_words, phrases and templates: where the wordings stand, as (label, start, end, words) ordered by label and start.

    ``start`` and ``end`` (exclusive) count the text's words from 0; ``words`` is the number of mandatory words. ``phrases`` are
    templates too, by label; all of their places are listed, as none is inside another. Whole texts are read; null and
    empty texts have no words and no places; each row has its own result, repeated and null ids included; other columns
    are ignored, whatever their names; an empty table gives no rows. Places don't reach over the end of a text.
    """
    ship_package(docs.sparkSession)
    machines = [compiled(phrases), compiled(templates)]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("phrases", PLACE), T.StructField("templates", PLACE)])

    def listed(machine: Automaton, words: tuple, first: np.ndarray) -> pa.Array:
        start, end, label = places(machine, word_codes(*words, machine.vocabulary), first)
        owner = np.searchsorted(first, start, side="right") - 1
        order = np.argsort(owner, kind="stable")
        owner, start, end, label = owner[order], start[order], end[order], label[order]
        values = [pa.array([machine.labels[x] for x in label], pa.string()), *map(pa.array, (start - first[owner], end - first[owner], machine.weights[label]))]
        rows = pa.StructArray.from_arrays(values, ["label", "start", "end", "words"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first))), pa.int32()), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = text_buffer(batch.column(text))
            for a, b in batch_slices(starts):
                some = raw[starts[a]:starts[b]]
                begin, end, first = word_bounds(some, starts[a:b + 1] - starts[a], _BETWEEN)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first), pa.int64()),
                    *(listed(machine, (some, begin, end), first) for machine in machines)], schema.names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


# --- fixed values: published licence wording, with markup of our own ---------------------------------------

TITLE = '<<beginOptional>><<beginOptional>>The <<endOptional>>{0} License<<endOptional>> <<beginOptional>>Copyright <<var;name="copyright";match=".+">><<endOptional>> '

NOTICES = {
    "mit-notice": """<<var;name="verb";match="released|licensed|distributed|available|published">> under the
        <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>open source<<endOptional>> MIT License""",
    "apache-2.0": """Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2.0""",
    "gpl-2.0": """<<var;name="verb";match="licensed|released|distributed|redistribute it and/or modify it">> under the <<beginOptional>>terms of the<<endOptional>>
        GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> version 2""",
    "gpl-3.0": """<<var;name="verb";match="licensed|released|distributed|redistribute it and/or modify it">> under the <<beginOptional>>terms of the<<endOptional>>
        GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3""",
}

WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;name="holder";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """

THIRD_CLAUSE = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";match=".+">> nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. """

TEXTS = {
    "mit-text": TITLE.format("MIT") + """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";match=".+">> BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": TITLE.format("ISC") + """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause": CLAUSES + WARRANTY,
    "bsd-3-clause": CLAUSES + THIRD_CLAUSE + WARRANTY,
}

#: Which Creative Commons licences there are: what may follow the two letters of attribution.
ATTRIBUTION = ["", "NC", "ND", "SA", "NC-SA", "NC-ND"]
CREATIVE_COMMONS = {
    "-".join(["cc-by", *([x.lower()] if x else []), "4.0"]):
        f'<<var;name="verb";match="licensed|released|available|shared">> under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY {x} 4.0'
    for x in ATTRIBUTION}

TEMPLATES = NOTICES | CREATIVE_COMMONS | TEXTS
