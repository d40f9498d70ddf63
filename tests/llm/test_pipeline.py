"""The pipeline against its stages stated plainly, and the registered queries against their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitetide.llm import mixing, queries, quality_rff

from .helpers import ODD_ROWS, documents, near_groups, shingles, tokens

SMALL = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "conversations"]


def copies_of(doc_id, rate):
    """The draw of a document, from the hash and the distribution alone."""
    if rate <= 0:
        return 0
    parts = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
    n = 0
    for part in range(parts):
        u = int(hashlib.md5(f"{queries.MIX_SEED}|{doc_id}|{part}".encode()).hexdigest()[:13], 16) / mixing.DRAWS
        term = total = math.exp(-rate / parts)
        k = 0
        while total <= u:
            k += 1
            term *= rate / parts / k
            total += term
        n += k
    return n


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # the classifier's scores are taken as they are; what they and the other stages decide is restated
    model = quality_rff.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), corpus_pipeline.F.lit(True))
    scored = quality_rff.score_documents(docs, model).collect()
    kept = {r.doc_id: r for r in scored if r.score >= 0.5}
    assert 0 < len(kept) < len(scored)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i].text or ""), i)
    kept = {i: kept[i] for i in first.values()}
    groups = near_groups({i: shingles(r.text) for i, r in kept.items()}, threshold=80)
    kept = {i: r for i, r in kept.items() if groups[i] == i}
    size = Counter()
    pool = lambda r: r.source if r.source in queries.MIX_WEIGHTS else None
    for r in kept.values():
        size[pool(r)] += len((r.text or "").encode())
    weight = {k: queries.MIX_WEIGHTS.get(k, queries.MIX_OTHERS) for k in size}
    rate = {k: weight[k] / sum(weight.values()) * sum(size.values()) / size[k] for k in size}
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, r in kept.items():
        if n := copies_of(i, rate[pool(r)]):
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want[(i, r.lang, r.source, len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest())] = n
    got = Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def test_near_copies_from_four_fifths_go(spark):
    # 104 words have 100 shingles: k new words at the end leave 100 - k of 100 + k; 10 and 11 are in [0.80, 0.85), 12 is below
    rows = []
    for k in (8, 10, 11, 12):
        words = [f"c{k}w{i}" for i in range(104)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:104 - k], *(f"new{k}x{i}" for i in range(k))]))]
    sets = {i: shingles(t) for i, t in rows}
    similarity = {k: len(sets[10 * k] & sets[10 * k + 1]) / len(sets[10 * k] | sets[10 * k + 1]) for k in (8, 10, 11, 12)}
    assert similarity[8] >= 0.85 > similarity[10] > similarity[11] >= 0.80 > similarity[12]
    left = corpus_pipeline.near_duplicates(spark, documents(spark, rows), SMALL)
    assert sorted(r.doc_id for r in left.collect()) == [80, 100, 110, 120, 121]


def test_odd_rows_pass_the_stages(spark, tmp_path):
    documents(spark, ODD_ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in got)
    # of the two PROSE ids one stays, and of the empty and the long texts; rows without id are documents of their own
    assert {r.doc_id for r in got} <= {i for i, *_ in ODD_ROWS} - {2, 5, 10}


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "bpe_encoding"]
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SMALL)
        assert out.count() == 0
        if at < 4:
            assert out.columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    frame = queries.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(frame.columns)
    want = Counter(tuple(row) for row in found.fetchall())
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == want


def test_every_operator_has_its_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_queries_without_sql_give_their_columns(spark):
    # their rows are held against brute force by the tests of their operators; here the registered queries run over a whole table
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = {n: queries.QUERIES[n](spark, SMALL).collect() for n in queries.QUERIES if n not in queries.ORACLES}
    assert set(rows) == {"op2_sharding", "op4_tensor_minhash", "op5_bloom_lm", "op6_separator_scan", "op7_trie_bpe", "op9_quality_classifier"}
    assert all(sorted(r.doc_id for r in found) == sorted(docs) for found in rows.values())
    shards = Counter(r.shard for r in rows["op2_sharding"])
    assert max(shards.values()) - min(shards.values()) <= 1 and sorted(shards) == list(range(40))
    assert all(r.size == len((docs[r.doc_id].text or "").encode()) + 16 for r in rows["op2_sharding"])
    groups = near_groups({i: shingles(d.text) for i, d in docs.items()})
    assert all((r.component_id, r.kept) == (groups[r.doc_id], groups[r.doc_id] == r.doc_id) for r in rows["op4_tensor_minhash"])
    known = Counter(w for i, d in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*tokens(d.text), None])
    for r in rows["op5_bloom_lm"]:
        words = [*tokens(docs[r.doc_id].text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(known[w] > 0 for w in words), sum(known.values()))
        base = sum(math.log10((known[w] + 0.5) / (r.train_tokens + 0.5 * (len(known) + 1))) for w in words)
        assert abs(r.base_score - base) < 1e-6
    library = Tokenizer.from_file(queries.tokenizer_path())
    for r in rows["op7_trie_bpe"]:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for r in rows["op9_quality_classifier"] if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)
