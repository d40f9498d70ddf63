"""Language-model scores and the quality classifier."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitetide.llm import bloom_lm, quality_rff
from sitetide.llm.common import text_buffer, word_bounds, word_hashes

from .helpers import DOCUMENTS, ODD_ROWS, documents, tokens


def lm_words(text):
    return [*tokens(text), None]


def test_base_scores_are_exact(spark):
    rows = ODD_ROWS + [(100 + i, " ".join(f"v{(i * k) % 37}" for k in range(i))) for i in range(40)]
    got = bloom_lm.score_documents(documents(spark, rows), F.col("doc_id") % 3 != 1).collect()
    learnt = Counter(w for i, t, *_ in rows if i is not None and i % 3 != 1 for w in lm_words(t))
    n, v = sum(learnt.values()), len(learnt)
    want = Counter()
    for i, t, *_ in rows:
        words = lm_words(t)
        base = sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[(i, len(words), sum(learnt[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_blocks_and_ranges_do_not_change_scores(spark, monkeypatch):
    rows = [(i, " ".join(f"v{(i * k) % 37}" for k in range(i))) for i in range(60)]
    score = lambda: {r.doc_id: (round(r.base_score, 8), r.n_known, r.n_tokens) for r in bloom_lm.score_documents(documents(spark, rows), F.col("doc_id") > 5).collect()}
    one = score()
    monkeypatch.setattr(bloom_lm, "BLOCK", 2000)
    monkeypatch.setattr(bloom_lm, "RANGE_TOKENS", 150)
    assert score() == one


def test_filter_holds_quantised_counts(spark):
    rows = [(i, " ".join(["often"] * 9 + ["pair", "up"] + [f"once{i}"])) for i in range(50)]
    model = bloom_lm.fit(documents(spark, rows), bits_per_token=64)
    hash_of = lambda w: word_hashes(*(lambda raw: (raw, *word_bounds(raw, np.array([0, len(raw)]))[:2]))(np.frombuffer(w.encode(), np.uint8)))
    count = lambda w: model.counts(bloom_lm.unigram_keys(hash_of(w)))[0]
    # 450 and 50 occurrences: the middle of 256..511 and 32..63; 1; none
    assert (count("often"), count("pair"), count("once7"), count("never")) == (383.5, 47.5, 1.0, 0.0)
    assert model.counts(bloom_lm.bigram_keys(hash_of("pair"), hash_of("up")))[0] == 47.5
    assert model.distinct == 53 + 1 and model.train_tokens == 50 * 13


def test_scores_need_no_whole_filter(spark, monkeypatch):
    # the filter is looked up chunk by chunk: neither sent to all tasks nor bounded, and the scores are those of quantised counts
    monkeypatch.setattr(bloom_lm, "BLOCK", 2000)
    monkeypatch.setattr(bloom_lm, "RANGE_TOKENS", 150)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the filter was broadcast"))
    rows = [(i, " ".join(f"v{(i * k) % 37}" for k in range(i))) for i in range(60)]
    got = bloom_lm.score_documents(documents(spark, rows), F.col("doc_id") > 5, bits_per_token=1024).collect()
    single, both = Counter(), Counter()
    for i, t in rows:
        if i > 5:
            words = ["START", *lm_words(t)]
            single.update(words)
            both.update(zip(words, words[1:]))
    n, v = sum(single.values()) - single["START"], len(single) - 1
    held = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0
    for r in got:
        words, want = ["START", *lm_words(rows[r.doc_id][1])], 0
        for a, b in zip(words, words[1:]):
            w = 0.7 if single[a] else 0
            want += math.log10(w * min(1, max(held(both[a, b]) - 0.75, 0) / max(held(single[a]), 1)) + (1 - w) * min(1, (held(single[b]) + 0.5) / (n + 0.5 * (v + 1))))
        assert abs(r.score - want) < 1e-6
    fits = [bloom_lm.fit(documents(spark, rows[:k])) for k in (15, 60)]
    assert fits[1].n_chunks > fits[0].n_chunks
    assert all(m.n_chunks * m.chunk_bits >= 6 * m.train_tokens for m in fits)


def test_what_a_chunk_gets_does_not_grow_with_documents():
    # END is in each text: its chunk gets one key, and what blocks keep isn't all in one chunk
    bounds = bloom_lm.range_bounds(4)
    make = lambda block, n: list(bloom_lm._block_rows(block, [list(range(n))], [np.full(n, bloom_lm.END)], [np.ones(n, int)], bounds))
    asked = [sum(len(r[5] or b"") + len(r[6] or b"") for r in make("0-0", n)) for n in (10, 10_000)]
    assert asked[0] == asked[1] == 2 * bloom_lm.WORD_BYTES + bloom_lm.PAIR_BYTES


def test_rows_of_a_block_do_not_grow_with_chunks():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    for n_chunks in (100, 1_000_000):  # the latter is some terabytes of text
        bounds = bloom_lm.range_bounds(n_chunks)
        rows = list(bloom_lm._block_rows("0-0", [[1]], [tokens], [np.array([len(tokens)])], bounds))
        assert len(rows) <= 1 + min(n_chunks, bloom_lm.MOST_PARTS)
        asked = [r for r in rows if r[5] is not None]
        assert sum(len(r[5]) for r in asked) == 8 * (len(np.unique(tokens)) + 1)
        first = bloom_lm.first_chunks(n_chunks)
        for r in asked[:50]:
            assert len(r[7]) == len(r[8]) == 4 * (first[r[4] + 1] - first[r[4]]) or b"" in (r[7], r[8])
            assert np.frombuffer(r[7], np.uint32).sum() * 8 == len(r[5]) and np.frombuffer(r[8], np.uint32).sum() * 4 == len(r[6])


@pytest.mark.parametrize("n_chunks", [1, 7, 8192, 8193, 100_000])
def test_parts_are_ranges_of_chunks(spark, n_chunks):
    first = bloom_lm.first_chunks(n_chunks)
    chunks = np.unique(np.linspace(0, n_chunks - 1, 300).astype(int)).tolist()
    got = spark.createDataFrame([(c,) for c in chunks], "chunk int").select("chunk", bloom_lm.part_of(F.col("chunk"), n_chunks).alias("p")).collect()
    assert all(first[r.p] <= r.chunk < first[r.p + 1] for r in got)


def test_parts_of_several_chunks_give_the_same_scores(spark, monkeypatch):
    rows = [(i, " ".join(f"v{(i * k) % 37}" for k in range(i))) for i in range(60)]
    score = lambda: {r.doc_id: (round(r.base_score, 8), round(r.score, 8), r.n_known) for r in bloom_lm.score_documents(documents(spark, rows), F.col("doc_id") > 5, bits_per_token=1024).collect()}
    monkeypatch.setattr(bloom_lm, "BLOCK", 2000)
    monkeypatch.setattr(bloom_lm, "RANGE_TOKENS", 50)
    one = score()
    monkeypatch.setattr(bloom_lm, "MOST_PARTS", 3)
    monkeypatch.setattr(bloom_lm, "HELD_BACK", 40)
    assert score() == one


def test_what_blocks_keep_is_spread():
    bounds = bloom_lm.range_bounds(4)
    make = lambda block, n: list(bloom_lm._block_rows(block, [list(range(n))], [np.full(n, bloom_lm.END)], [np.ones(n, int)], bounds))
    assert {make(f"{task}-0", 3)[0][4] for task in range(40)} == {0, 1, 2, 3}


def test_probabilities_are_at_most_one(spark):
    # four ends: the middle of their level is 5.5 of 4
    got = bloom_lm.score_documents(documents(spark, [(i, "") for i in range(4)]), F.lit(True)).collect()
    assert all(r.score <= 0 for r in got)


def test_learnt_word_order_scores_higher(spark):
    rng = random.Random(1)
    grammar = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}

    def text():
        words = ["w0"]
        for _ in range(80):
            words.append(rng.choice(grammar[words[-1]]))
        return words

    rows = [(i, " ".join(text())) for i in range(150)]
    for i in range(30):
        words = text()
        shuffled = rng.sample(words, len(words))
        rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join(shuffled))]
    got = {r.doc_id: r for r in bloom_lm.score_documents(documents(spark, rows), F.col("doc_id") < 1000).collect()}
    better = sum(got[1000 + i].score > got[2000 + i].score + 10 for i in range(30))
    assert better == 30
    assert sum(got[1000 + i].score > got[1000 + i].base_score for i in range(30)) == 30


def test_nothing_to_learn_from(spark):
    got = bloom_lm.score_documents(documents(spark, ODD_ROWS), F.lit(False)).collect()
    assert len(got) == len(ODD_ROWS) and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert bloom_lm.score_documents(spark.createDataFrame([], DOCUMENTS), F.lit(True)).count() == 0


def test_words_of_batches():
    texts = ["a\tb  C", None, "", " x", "\x1cé\x0b", "c"]
    raw, starts = text_buffer(pa.array(texts))
    begin, end, first = word_bounds(raw, starts)
    words = [raw[a:b].tobytes().decode().translate({67: 99}) for a, b in zip(begin, end, strict=True)]
    assert words == ["a", "b", "c", "x", "\x1cé", "c"] and first.tolist() == [0, 3, 3, 3, 4, 5, 6]
    hashes = word_hashes(raw, begin, end)
    assert hashes[2] == hashes[5] and len(set(hashes.tolist())) == 5


# --- quality ---------------------------------------------------------------------------------------------


def quality_rows(n):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "$$$" for w in words)))
        labels.append((i, int(good), "x"))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = quality_rows(800)
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_rff.fit(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality_rff.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == bool(q) for i, q, _ in labels if i % 5 == 0]
    assert sum(right) / len(right) > 0.98


def test_scores_use_the_text_alone(spark):
    rows, labels = quality_rows(300)
    marks = spark.createDataFrame(labels + [(7, None, None), (7, 1, None), (99999, 0, None), (None, 1, None)], "doc_id long, quality int, text string")
    model = quality_rff.fit(documents(spark, rows), marks, F.lit(True))
    odd = [*ODD_ROWS, *[(-i, t, "other") for i, t in rows[:20]]]
    got = quality_rff.score_documents(documents(spark, odd), model)
    assert got.columns == [c for c in DOCUMENTS.names if c != "score"] + ["score"]
    by_text = {}
    for r in got.collect():
        assert 0 <= r.score <= 1
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(max(s) - min(s) < 1e-8 for s in by_text.values())
    again = {r.doc_id: r.score for r in quality_rff.score_documents(documents(spark, rows[:20]), model).collect()}
    assert all(abs(again[i] - min(by_text[t])) < 1e-8 for i, t in rows[:20])


def test_fit_equals_plain_algebra(spark, monkeypatch):
    monkeypatch.setattr(quality_rff, "SUBTREES", 2)  # several levels of sums
    rows, labels = quality_rows(240)
    rows.append((7, "Another text of a known id"))
    labels.append((9, 0, "x"))  # a second label
    docs, marks = documents(spark, rows).repartition(9), spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_rff.fit(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality_rff.score_documents(docs, model).collect() if r.doc_id != 7}

    def numbers(text):
        return quality_rff.statistics(*text_buffer(pa.array([text])))[0]

    fold = {r.doc_id: r.k for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(3)).alias("k")).distinct().collect()}
    train = [(numbers(t), q, fold[i]) for i, t in rows for j, q, _ in labels if i == j and i % 5 != 0]
    x, y, k = np.array([a for a, _, _ in train]), np.array([b for _, b, _ in train], float), np.array([c for _, _, c in train])
    mean, deviation = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    random_ = np.random.default_rng(41)
    frequencies, phases = random_.normal(size=(18, 128)) / 4.0, random_.uniform(0, 2 * np.pi, 128)

    def features(v):
        z = np.clip((v - mean) / deviation, -6, 6) @ frequencies + phases
        return np.column_stack([np.cos(z) * np.sqrt(2 / 128), np.ones(len(v))])

    def ridge(rows_):
        z = features(x[rows_])
        return np.linalg.solve(z.T @ z + 1e-3 * len(x) / 129 * np.eye(129), z.T @ y[rows_])

    everything = np.arange(len(x))
    assert np.allclose(model.weights, ridge(everything), atol=1e-6)
    left_out = np.array([features(x[[i]])[0] @ w for i, w in zip(everything, [{f: ridge(everything[k != f]) for f in range(3)}[c] for c in k])])
    bins = {}
    for s, label in zip(left_out, y):
        bins.setdefault(int(np.clip((s + 1) / 3 * 3072, 0, 3071)), []).append((s, label))
    pooled = [(np.mean([s for s, _ in b]), np.mean([q for _, q in b]), len(b)) for _, b in sorted(bins.items())]
    knots, levels = quality_rff.isotonic(*(np.array(c, float) for c in zip(*pooled)))
    for i, t in rows[:-1]:
        if i != 7:
            want = np.interp(features(numbers(t)[None])[0] @ ridge(everything), knots, levels)
            assert abs(got[i] - np.clip(want, 0, 1)) < 1e-4


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rff.fit(documents(spark, ODD_ROWS), none, F.lit(True))
    assert {r.score for r in quality_rff.score_documents(documents(spark, ODD_ROWS), model).collect()} == {0.5}
    one_class = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    model = quality_rff.fit(documents(spark, ODD_ROWS), one_class, F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality_rff.score_documents(documents(spark, ODD_ROWS), model).collect())
    assert quality_rff.score_documents(spark.createDataFrame([], DOCUMENTS), model).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_best_rising_fit(seed):
    rng = np.random.default_rng(seed)
    y, w = rng.normal(size=40), rng.integers(1, 5, 40).astype(float)
    x, level = quality_rff.isotonic(np.arange(40.0), y, w)
    assert (np.diff(level) >= 0).all() and (np.diff(x) > 0).all()
    # the classical formula: the largest over starts of the smallest over ends of the means
    mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(level, 9))))
