"""Vector codes and hard negatives against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitetide.llm import hard_negatives, member_lloyd

ODD = [
    (0, [1.0, 2.0, 0.5, 0.0], 1), (1, [1.0, None, 1.0, 1.0], 1), (2, None, 2), (3, [float("nan"), 1.0, 1.0, 1.0], 2), (4, [float("inf"), 1.0, 1.0, 1.0], 3),
    (5, [3.0, 3.0, 0.0, 1.0], None), (6, [3.0, 3.0, 0.0, 1.0], 1), (6, [3.0, 3.0, 0.0, 1.0], 1), (100, [1.0, 2.0, 0.5, 0.0], 2), (7, [0.0, 0.0, 0.0, 0.0], 2),
    (None, [2.0, 2.0, 0.0, 1.0], 1), (200, [0.0, 0.0, 0.0, 0.0], 1), (8, [1e30, 0.0, 0.0, 0.0], 1), (9, [1.0, 1.0], 1), (300, [-1.0, -2.0, 0.0, 0.5], 3),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, error string")


def usable(v, scale, most):
    bound = min(2.0 ** 31 - 1, (most / max(1, len(v or []))) ** 0.5)
    return v is not None and all(x is not None and abs(float(np.float32(x)) * scale) < bound for x in v)


def whole(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


# --- codes ------------------------------------------------------------------------------------------------


def lloyd(rows, n_parts=4, n_entries=256, rounds=4, scale=1024):
    """The rounds on lists of whole numbers."""
    kept = [(i, whole(v, scale), label) for i, v, label in rows if usable(v, scale, member_lloyd.MOST)]
    sizes = [len(v) for _, v, _ in kept]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if kept else 0
    kept = [r for r in kept if len(r[1]) == size]
    cuts = [size * i // n_parts for i in range(n_parts + 1)]
    part = lambda v, p: tuple(v[cuts[p]:cuts[p + 1]])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:n_entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(n_parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((apart(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds if kept else 0):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(part(v, p), book)[1], []).append(part(v, p))
            books[p] = [tuple(sum(c) // len(members[i]) for c in zip(*members[i], strict=True)) if i in members else e for i, e in enumerate(book)]
    found = []
    for i, v, label in kept:
        best = [near(part(v, p), book) for p, book in enumerate(books)]
        found.append((i, label, [e for _, e in best], sum(d for d, _ in best)))
    return found, books


def assert_compressed(spark, rows, **given):
    got = member_lloyd.compress(frame(spark, rows), keep=("vec_id", "label"), **given)
    want, books = lloyd(rows, **given)
    order = lambda x: sorted(x, key=repr)
    assert order((r.vec_id, r.label, list(r.entries), r.error) for r in got.codes.collect()) == order(want)
    assert [[tuple(e) for e in book.tolist()] for book in got.codebooks] == books
    return got


@pytest.mark.parametrize("size,entries,rounds", [(8, 16, 4), (6, 5, 2), (3, 4, 1), (8, 300, 3), (8, 4, 0)])
def test_codes_equal_plain_rounds(spark, size, entries, rounds):
    rng = np.random.default_rng(size + entries)
    rows = [(i, [float(x) for x in rng.normal(size=size) + 3 * (i % 3)], i % 4) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(70)]  # a third of all rows is one vector
    assert_compressed(spark, rows, n_entries=entries, rounds=rounds)


def test_hot_entries_have_several_owners(spark, monkeypatch):
    monkeypatch.setattr(member_lloyd, "MEMBERS", 10)
    rng = np.random.default_rng(2)
    assert_compressed(spark, [(i, [float(x) for x in rng.normal(size=4) * (i % 3)], 1) for i in range(120)], n_entries=7, rounds=3)


def test_only_movers_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 5 * (i % 6)], 1) for i in range(200)]
    arrived, moved = [], member_lloyd.Members.moved

    def counted(self, assignment):
        out = moved(self, assignment)
        arrived.append(spark.read.parquet(self.paths[1]).count())
        assert out.count() == 4 * 200
        return out

    monkeypatch.setattr(member_lloyd.Members, "moved", counted)
    member_lloyd.compress(frame(spark, rows), n_entries=6)
    assert arrived[0] == 800 and sum(arrived[1:]) < 400


def test_odd_vectors_have_codes(spark):
    got = assert_compressed(spark, ODD, n_entries=3, rounds=2)
    assert got.codes.columns == ["vec_id", "label", "entries", "error"]
    assert got.codes.count() == 9  # null ids and labels and repeated rows too
    assert_compressed(spark, [(1, [], 1), (2, [], None)])
    empty = member_lloyd.compress(frame(spark, ODD).limit(0))
    assert empty.codes.count() == 0 and [len(b) for b in empty.codebooks] == [0] * 4


def test_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    points, book = rng.integers(-(1 << 26), 1 << 26, (50, 9)), rng.integers(-(1 << 26), 1 << 26, (6, 9))
    index, error = member_lloyd.nearest(points, book)
    for x, i, e in zip(points.tolist(), index, error, strict=True):
        assert (e, i) == min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), j) for j, entry in enumerate(book.tolist()))


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    got = member_lloyd.compress(frame(spark, rows), n_entries=64)
    vectors = {i: np.array(v) for i, v, _ in rows}
    worst = [np.abs(member_lloyd.decompress(r.entries, got.codebooks) - vectors[r.vec_id]).mean() for r in got.codes.collect()]
    assert np.mean(worst) < 0.25


# --- hard negatives ---------------------------------------------------------------------------------------


def mined(rows, is_anchor, n_positives=5, n_negatives=5, lowest=80, highest=100):
    kept = [(i, whole(v, 256), label) for i, v, label in rows if i is not None and label is not None and usable(v, 256, 2.0 ** 62)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for at, (anchor, v, label) in enumerate(kept):
        if not is_anchor(anchor):
            continue
        others = [(score(v, w), j, other == label) for k, (j, w, other) in enumerate(kept) if k != at and len(w) == len(v)]
        positives = sorted((-s, j) for s, j, same in others if same)[:n_positives]
        for nth, (p, positive) in enumerate(positives, 1):
            hard = sorted((-s, j) for s, j, same in others if not same and lowest * -p <= 100 * s <= highest * -p)[:n_negatives]
            out += [(anchor, positive, rank, j, -p, -s, nth) for rank, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def assert_mined(spark, rows, every, **given):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % every == 0, **given)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    want = mined(rows, lambda i: i % every == 0, **given)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_plain_search(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "NUMBERS", 300)  # many small buckets
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=6) / 2) * (1 + i % 3)], (i + (i % 11 == 0)) % 4) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(120)]  # ties; a third of all rows is one vector
    want = assert_mined(spark, rows, 10, lowest=50 + 10 * seed)
    assert len(want) > 100


def test_odd_vectors_are_mined(spark):
    assert_mined(spark, ODD, 100)
    assert_mined(spark, ODD, 1, n_positives=2, n_negatives=3)
    assert hard_negatives.mine(frame(spark, ODD).limit(0), F.lit(True)).count() == 0
    text = frame(spark, ODD).withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert hard_negatives.mine(text, F.col("vec_id") % 100 == 0).count() == len(mined(ODD, lambda i: i % 100 == 0))


def test_feasible_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(5)
    numbers = np.concatenate([rng.integers(-40, 40, (400, 8)), np.zeros((3, 8), np.int64)])
    numbers[:200, 0] += 300
    bucket = hard_negatives.Bucket(np.arange(403), np.arange(403), [1] * 403, numbers)
    found = 0
    for query in [*rng.integers(-40, 40, (20, 8)), np.array([300, 9, -5, 0, 0, 2, 1, 1]), np.zeros(8, np.int64)]:
        scores = numbers @ query
        for least in [int(np.sort(scores)[-5]), 0, -3, int(scores.max()) + 1, int(scores.min())]:
            kept = bucket.feasible(query, least)
            assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist()) and len(set(kept.tolist())) == len(kept)
            found += len(kept) < 403
    assert found > 20
    wanted = np.arange(403) % 2 == 0
    for query in rng.integers(-40, 40, (20, 8)):
        which, scores = bucket.best(query, 7, wanted)
        order = sorted((-int(s), i) for i, s in enumerate(numbers @ query) if i % 2 == 0)[:7]
        assert [(-int(s), int(i)) for i, s in zip(which, scores, strict=True)] == order


def test_hot_labels_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LOOKUP_ROWS", 1)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0 if i % 3 == 0 else i) for i in range(200)]
    assert_mined(spark, rows, 9)
