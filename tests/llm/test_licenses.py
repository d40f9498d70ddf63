"""Licence templates against regular expressions over words, and places against plain positions."""

import random
import re

import pytest

from sitetide.llm import license_scan as L
from sitetide.llm import queries

from .helpers import DOCUMENTS, LOWER, ODD_ROWS, documents


def found(spark, rows, phrases=queries.LICENSE_PHRASES, templates=L.TEMPLATES):
    return L.scan_licenses(documents(spark, rows), phrases, templates).collect()


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_optional_and_replaceable_regions(spark):
    templates = {"t": 'alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> <<var;name="x";match=".+">> omega <<var;match="one|two three">>'}
    accepted = ["alpha x omega one", "alpha beta x y omega two three", "Alpha, beta (gamma) x: OMEGA -- One", "alpha " + "w " * 40 + "omega one", "alpha omega omega one"]
    refused = ["alpha omega one", "alpha x omega two", "alpha " + "w " * 41 + "omega one", "beta x omega one", "alpha x omeg a one", "alpha x"]
    got = found(spark, list(enumerate(accepted + refused)), {}, templates)
    assert [len(r.templates) for r in sorted(got, key=lambda r: r.doc_id)] == [1] * len(accepted) + [0] * len(refused)
    first = next(r for r in got if r.doc_id == 2)
    assert [tuple(p) for p in first.templates] == [("t", 0, 6, 2)]


def test_published_texts_are_known(spark):
    mit = re.sub(r"<<var[^>]*>>", "Ann Author and others", L.TEXTS["mit-text"]).replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    bsd = re.sub(r"<<var[^>]*>>", "Ann Author", L.CLAUSES + L.THIRD_CLAUSE + L.WARRANTY)
    bsd = re.sub(r"<<beginOptional>>.*?<<endOptional>>", "*", bsd)
    rows = [(1, "Some code.\n" + mit + "\nrest"), (2, bsd), (3, mit.replace("substantial", "important")), (4, bsd.replace("Neither", "Not")),
            (5, "Licensed under the Apache License, Version 2.0."), (6, "Licensed under CC BY-NC 4.0."), (7, "available under a Creative Commons CC BY 4.0"),
            (8, "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of")]
    labels = {r.doc_id: {p.label for p in r.templates} for r in found(spark, rows)}
    assert labels == {1: {"mit-text"}, 2: {"bsd-3-clause"}, 3: set(), 4: set(), 5: {"apache-2.0"}, 6: {"cc-by-nc-4.0"}, 7: {"cc-by-4.0"}, 8: {"gpl-3.0"}}


def test_places_count_words(spark):
    rows = [(1, "MIT License, mit\tlicense! The GNU General Public License; apachelicense apache license CC-BY cc by"), (2, "mit licenses amit license mit-license")]
    got = {r.doc_id: r for r in found(spark, rows)}
    assert [(p.label, p.start, p.end) for p in got[1].phrases] == [
        ("gpl", 5, 9), ("apache", 10, 12), ("cc-by", 12, 14), ("cc-by", 14, 16), ("mit", 0, 2), ("mit", 2, 4)]
    assert [(p.label, p.start) for p in got[2].phrases] == [("mit", 4)] and got[2].n_words == 6


def test_places_do_not_span_texts(spark):
    got = found(spark, [(1, "the mit"), (2, "license gnu general public"), (3, "license")])
    assert all(not r.phrases and not r.templates for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_random_templates_equal_regular_expressions(spark, monkeypatch, seed):
    monkeypatch.setattr(L, "_STARTS", 7)
    rng = random.Random(seed)

    def region(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.55 or depth > 2:
                out.append(rng.choice("abc"))
            elif kind < 0.75:
                out.append("<<beginOptional>>" + region(depth + 1) + "<<endOptional>>")
            elif kind < 0.9:
                out.append(f'<<var;match=".{{{rng.randint(0, 1)},{rng.randint(1, 3)}}}">>')
            else:
                out.append('<<var;match="a b|c|d">>')
        return " ".join(out)

    templates = {f"t{i}": region(0) + f" {rng.choice('abcd')}" for i in range(12)}
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14)))) for i in range(80)]
    for r in found(spark, rows, {}, templates):
        line = "".join(w + " " for w in plain(rows[r.doc_id][1]))
        want = {t for t, x in templates.items() if re.search("(?:^| )" + L.pattern(L.parse(x)), line)}
        assert {p.label for p in r.templates} == want
        for p in r.templates:  # each place is accepted, and the longest from its start
            words = plain(rows[r.doc_id][1])
            ends = [e for e in range(len(words) + 1) if re.fullmatch(L.pattern(L.parse(templates[p.label])), "".join(w + " " for w in words[p.start:e]))]
            assert p.end == max(ends)


@pytest.mark.parametrize("bad", ["a <<endOptional>>", "<<beginOptional>> a", "<<var;name=x>> a", '<<var;match=".+">>'])
def test_bad_templates_are_errors(bad):
    with pytest.raises(ValueError):
        L.compiled({"t": bad})


def test_odd_rows(spark):
    rows = [*ODD_ROWS, (50, "mit license " * 3000), (51, "copyright " * 5000)]
    got = found(spark, rows)
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(i), len(plain(t))) for i, t, *_ in rows)
    many = next(r for r in got if r.doc_id == 50)
    assert [p.start for p in many.phrases] == list(range(0, 6000, 2)) and many.templates == []
    assert L.scan_licenses(spark.createDataFrame([], DOCUMENTS), queries.LICENSE_PHRASES, L.TEMPLATES).count() == 0
