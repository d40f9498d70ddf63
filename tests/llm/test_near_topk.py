"""Near duplicates and top-k search against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitetide.llm import bitsliced_topk, tensor_minhash
from sitetide.llm.components import components
from sitetide.operators import joins

from .helpers import DOCUMENTS, ODD_ROWS, PROSE, documents, near_groups, shingles


def assert_groups(spark, rows):
    got = tensor_minhash.near_duplicates(documents(spark, rows)).collect()
    sets = {}
    for i, text, *_ in rows:
        sets[i] = shingles(text)
    want = near_groups(sets)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)


def changed(words, n, seed):
    words = list(words)
    rng = random.Random(seed)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def test_copies_near_copies_and_chains(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in rng.sample(range(9000), 400)]
    rows = [(i, changed(words, i % 5, i)) for i in range(60)]  # copies of one text
    rows += [(100 + i, " ".join(words[i * 20:i * 20 + 330])) for i in range(4)]  # each like the next
    rows += [(200 + i, " ".join(f"own{i}x{k}" for k in range(i))) for i in range(30)]
    rows += [(300, "a b"), (301, "A  B"), (302, "a b c"), (303, None), (304, ""), (305, "")]
    assert_groups(spark, rows)


def test_a_hub_whose_copies_are_not_alike(spark):
    # each copy is like the hub, two copies are not: one leader a bucket does not find the links
    words = [f"h{i}" for i in range(300)]
    rows = [(500, " ".join(words))] + [(i, changed(words, 8, i)) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    assert len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.85
    assert_groups(spark, rows)


@pytest.mark.parametrize("block", [3, 8, 100])
def test_blocks_lose_no_link(spark, block):
    rng = random.Random(block)
    base = [[f"b{k}x{i}" for i in range(200)] for k in range(3)]
    rows = [(i, changed(base[i % 3], rng.randint(0, 9), i)) for i in range(50)]
    sets = {i: shingles(t) for i, t in rows}
    start = {i: 0 if i % 3 == 0 and i < 30 else i for i in sets}  # a large component and many small ones
    rest = spark.createDataFrame([(7, i, c) for i, c in start.items()], "key long, rep long, component long")
    texts = spark.createDataFrame(rows, "rep long, text string")
    links = tensor_minhash.block_links(rest, texts, 85, block=block).collect()
    for r in links:
        assert 100 * len(sets[r.a] & sets[r.b]) >= 85 * len(sets[r.a] | sets[r.b])
    joined = {i: i for i in sets}

    def top(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for a, b in [(r.a, r.b) for r in links] + list(start.items()):
        a, b = sorted((top(a), top(b)))
        joined[b] = a
    want = near_groups(sets)
    for i in sets:
        for j in sets:
            if want[i] == want[j]:
                assert top(i) == top(j)


def test_unlike_words_have_unlike_hashes(spark):
    # a sum of powers modulo 2 ** 64 takes these two words for one
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = tensor_minhash.near_duplicates(documents(spark, [(1, f"{word} w x y z"), (2, f"{other} w x y z"), (3, f"{word.upper()} w x y z")]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("threshold", [80, 85])
def test_hot_buckets_are_split(spark, monkeypatch, threshold):
    monkeypatch.setattr(joins, "HOT_ROWS", 8)
    monkeypatch.setattr(joins.join_hot, "__defaults__", (*joins.join_hot.__defaults__[:-1], 8))
    rng = random.Random(threshold)
    base = [[f"b{k}x{i}" for i in range(150)] for k in range(4)]
    rows = [(i, changed(base[i % 4], rng.randint(0, 8), i)) for i in range(120)]
    got = tensor_minhash.near_duplicates(documents(spark, rows), threshold).collect()
    want = near_groups({i: shingles(t) for i, t in rows}, threshold)
    assert {r.doc_id: r.component_id for r in got} == want


def test_odd_documents(spark):
    got = tensor_minhash.near_duplicates(documents(spark, ODD_ROWS)).collect()
    assert len(got) == len(ODD_ROWS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 2) for r in by_id[i]} == {1} and by_id[3][0].component_id == 3
    assert {r.component_id for i in (7, 8) for r in by_id[i]} == {7} and len(by_id[8]) == 2
    assert by_id[10][0].component_id == 9 and not by_id[10][0].kept
    assert [(r.n_shingles, r.component_id, r.kept) for r in by_id[4] + by_id[5]] == [(0, 4, True), (0, 5, True)]
    assert all(r.component_id is None and r.kept for r in by_id[None])
    left = tensor_minhash.drop_near_duplicates(documents(spark, ODD_ROWS))
    assert left.columns == DOCUMENTS.names
    assert {r.doc_id for r in left.collect()} == {r[0] for r in ODD_ROWS} - {2, 8, 10}
    assert tensor_minhash.near_duplicates(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_a_repeated_id_is_one_document(spark):
    other = PROSE.replace("e", "o")
    rows = [(1, PROSE), (5, PROSE), (5, other), (9, other)]
    got = tensor_minhash.near_duplicates(documents(spark, rows)).collect()
    assert {r.component_id for r in got} == {1}


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (101, 100), (7, 7), (300, 200)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- top k ------------------------------------------------------------------------------------------------


def best(vectors, queries, k):
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


@pytest.mark.parametrize("scale", [0.1, 1.0, 3e5])
def test_random_vectors_and_ties(spark, monkeypatch, scale):
    monkeypatch.setattr(bitsliced_topk, "VECTORS", 150)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(size=9) * scale if i % 4 else np.round(rng.normal(size=9)))], 1) for i in range(400)]
    rows += [(1000 + i, rows[1][1], 1) for i in range(60)]  # many ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = bitsliced_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 1), k=5)
    assert sorted(tuple(r) for r in got.collect()) == best([(i, whole(v)) for i, v, _ in rows], {i: whole(v) for i, v, _ in rows if i % 20 == 1}, 5)


def test_sums_of_slices_are_exact():
    rng = np.random.default_rng(8)
    values = rng.integers(-16, 15, size=(130, 7))
    block = bitsliced_topk.SlicedBlock(np.arange(130), values)
    for query in rng.integers(-300, 300, size=(20, 7)):
        slices, added = block.sums(query)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << w for w, s in enumerate(slices))
        leading = (values - block.low) >> block.shift
        assert (total - added == leading @ query).all()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, -1.0]), (50, [0.5, 0.5]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [3.0, 3.0]), (6, [3.0, 3.0]), (6, [3.0, 3.0]), (7, [1.0]), (None, [9.0, 9.0]), (100, [2.0]), (150, []), (151, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in bitsliced_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).collect())
    usable = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == best(usable, {0: whole([1.0, 2.0]), 50: whole([0.5, 0.5]), 100: whole([2.0]), 150: []}, 5)
    assert bitsliced_topk.top_k(vectors.limit(0), vectors).count() == 0
