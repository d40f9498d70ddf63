"""Exact dedup, sharding and mixing."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitetide.llm import exact_dedup, mixing, sharding
from sitetide.llm.common import running_offsets

from .helpers import DOCUMENTS, ODD_ROWS, documents


def content(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_equal_texts_are_marked(spark):
    got = exact_dedup.mark_duplicates(documents(spark, ODD_ROWS)).collect()
    groups = defaultdict(list)
    for i, text, *_ in ODD_ROWS:
        groups[content(text)].append(i)
    assert len(got) == len(ODD_ROWS)
    for row in got:
        ids = next(g for c, g in groups.items() if hashlib.sha256(c.encode()).hexdigest() == row.text_sha256)
        known = [i for i in ids if i is not None]
        assert row.group_size == len(ids) and row.doc_id in ids
        assert row.keep_id == (min(known) if known else None)
        assert row.kept == (row.doc_id == row.keep_id)


def test_survivors_keep_their_columns(spark):
    docs = documents(spark, ODD_ROWS)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    rows = {content(r.text): r for r in got.collect()}
    assert len(rows) == got.count() == len({content(t) for _, t, *_ in ODD_ROWS})
    first = min((i, t) for i, t, *_ in ODD_ROWS if i is not None and content(t) == content(ODD_ROWS[0][1]))
    kept = rows[content(ODD_ROWS[0][1])]
    assert (kept.doc_id, kept.text, kept.lang, kept.shard) == (*first, "en", "x")
    assert rows[""].doc_id == 4 and rows[""].text is None


def test_unequal_texts_under_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    got = exact_dedup.mark_duplicates(documents(spark, ODD_ROWS))
    assert got.select("text_sha256").distinct().count() == len({content(t) for _, t, *_ in ODD_ROWS})
    assert exact_dedup.drop_duplicates(documents(spark, ODD_ROWS)).count() == len({content(t) for _, t, *_ in ODD_ROWS})


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 20])
def test_shards_are_even_and_without_gaps(spark, bucket_bytes):
    rows = ODD_ROWS + [(1000 + i, "t" * (i % 50)) for i in range(200)] + [(5000, "again")] * 150
    got = sharding.shard(documents(spark, rows), 7, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_shuffled_order_depends_on_the_seed_alone(spark):
    docs = documents(spark, [(i, str(i)) for i in range(300)])
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, 5, seed=seed, bucket_bytes=500).collect()}
    assert place(1) == place(1) != place(2)
    in_order = [i for i, _ in sorted(place(1).items(), key=lambda kv: (kv[1][1], kv[1][0]))]
    moved = sum(abs(a - b) for a, b in enumerate(in_order)) / 300
    assert moved > 60  # a random permutation moves by a third of the length


@pytest.mark.parametrize("copies", [sharding.COPIES, 4000])
def test_shards_do_not_depend_on_splits(spark, copies):
    rows = [(i, str(i)) for i in range(300)] + [(5000, "again")] * copies + [(None, None)] * 3
    docs = documents(spark, rows)
    place = lambda df: sorted((r.doc_id or -1, r.shard, r.slot) for r in sharding.shard(df, 5, bucket_bytes=500).collect())
    first = place(docs.coalesce(1))
    assert place(docs.repartition(3)) == first and place(docs.orderBy(F.rand(1)).repartition(7)) == first


def test_shards_of_rows_with_maps(spark):
    rows = spark.createDataFrame([(i, "t", {"b": i, "a": None}, [{"x": 1}] if i else None) for i in range(9)], "doc_id long, text string, m map<string,int>, l array<map<string,int>>")
    got = sharding.shard(rows.drop("l"), 2)
    assert sorted((r.doc_id, sorted(r.m)) for r in got.collect()) == [(i, ["a", "b"]) for i in range(9)]


def test_written_shards_read_back(spark, tmp_path):
    docs = documents(spark, [(i, str(i)) for i in range(90)])
    sharding.write_shards(sharding.shard(docs, 4).select("doc_id", "shard", "slot"), str(tmp_path / "s"), 6)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 4 and back.count() == 90


def test_offsets_are_prefix_sums(spark):
    counts = spark.createDataFrame([(b, k, k % 5) for b in ("x", "y") for k in range(0, 60, 3)], "file string, k long, n long")
    got = {(r.file, r.k): r.o for r in running_offsets(counts, "k", "n", "o", ("file",), block=7).collect()}
    assert got == {(b, k): sum(j % 5 for j in range(0, k, 3)) for b in ("x", "y") for k in range(0, 60, 3)}


def test_poisson_table_is_the_distribution():
    for mean in (0.01, 0.7, 3.0, 8.0):
        table = mixing.poisson_table(mean)
        exact = [sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1)) for k in range(len(table))]
        assert all(abs(t / mixing.DRAWS - e) < 1e-12 for t, e in zip(table, exact, strict=True))
        assert 1 - table[-1] / mixing.DRAWS < 1e-14


def test_sources_reach_their_weights(spark):
    rows = [(i, "x" * 100, f"s{min(i % 10, 3)}") for i in range(3000)] + [(9000, "y" * 100, "tiny")]
    got = mixing.mix_sources(documents(spark, rows), {"s0": 0.5, "s1": 0.2, "tiny": 0.02}, 0.28)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 3001) < 300
    assert abs(n["s0"] / total - 0.5) < 0.05 and abs(n["s1"] / total - 0.2) < 0.04
    assert 30 < n["tiny"] < 95  # one document, drawn in eight parts of mean 7.5
    per = got.groupBy("doc_id").agg(F.max("n_copies").alias("n"), F.count("*").alias("rows"), F.countDistinct("copy").alias("copies")).collect()
    assert all(r.n == r.rows == r.copies for r in per)


def test_thousands_of_sources(spark):
    weights = {f"s{i}": 1 + i % 3 for i in range(5000)}
    rows = [(i, "x" * 50, f"s{i % 5000}") for i in range(10_000)] + [(20_000, "y", "other"), (20_001, "y", None)]
    got = mixing.mix_sources(documents(spark, rows), weights, 10.0, epochs=3).groupBy("source").count().collect()
    n = Counter()
    for r in got:
        n[weights.get(r.source, 0)] += r["count"]
    assert abs(n[3] / n[1] - 3) < 0.3 and abs(n[2] / n[1] - 2) < 0.25


def test_many_copies_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(i, "x" * 90, "large") for i in range(50)] + [(99, "y" * 90, "tiny"), (99, "y" * 90, "tiny")]
    got = mixing.mix_sources(documents(spark, rows), {"large": 0.5, "tiny": 0.5}).collect()
    copies = sorted(r.copy for r in got if r.doc_id == 99)
    n = {r.n_copies for r in got if r.doc_id == 99}
    assert len(n) == 1 and copies == sorted([*range(1, n.copy().pop() + 1)] * 2) and 10 < len(copies)
    assert all(r.copy <= r.n_copies for r in got)


def test_odd_rows_are_mixed(spark):
    docs = documents(spark, ODD_ROWS)
    got = mixing.mix_sources(docs, {"src0": 0.7, "nowhere": 0.1}, 0.2, epochs=20)
    assert set(got.columns) == {*docs.columns, "n_copies", "copy", "shuffle_key"}
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r[0] for r in ODD_ROWS}
    keys = [r.shuffle_key for r in got.filter("doc_id = 8").collect()]
    assert Counter(Counter(keys).values()).keys() == {2}  # the repeated row repeats alike


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert exact_dedup.mark_duplicates(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0
    assert sharding.shard(empty, 3).count() == mixing.mix_sources(empty, {"src0": 1.0}).count() == 0


def test_crc_of_the_contract(spark):
    row = spark.range(1).select(F.crc32(F.lit("né")).alias("c")).first()
    assert row.c == zlib.crc32("né".encode())
