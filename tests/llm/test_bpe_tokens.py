"""BPE by prefixes against the tokenizer library; token counts against plain loops."""

import base64
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from sitetide.llm import separator_scan, trie_bpe
from sitetide.llm.common import handing_back
from sitetide.llm.queries import END_OF_DOCUMENT, tokenizer_path

from .helpers import DOCUMENTS, ODD_ROWS, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return trie_bpe.Encoder(f.read())


def encoded(own, texts):
    ids, at = own.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_every_token_and_random_strings(own, library):
    random.seed(11)
    letters = "aaabcdehilnorstuvwxyz'ABCßİΣσ́éñ \t\n\x1c\x85\xa0 　!?</|>123中\U0001F600"
    texts = [t.removesuffix("</w>") for t in library.get_vocab()]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(random.choice(["a", "in", "th", "the", "er", "o"]) for _ in range(30)) for _ in range(1000)]
    texts += ["<|endoftext|>A<|startoftext|> <|endoftext|", "한 Å Å"]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = encoded(own, texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w.ids] == []
    assert all(own.decode(np.array(g, int)) == library.decode(g, skip_special_tokens=False) for g in got)


def test_results_do_not_depend_on_what_is_remembered(own, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "REMEMBERED", 6)
    texts = [" ".join(f"word{i}ing other{i % 7}" for i in range(n)) for n in range(40)]
    assert encoded(own, texts) == encoded(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def traced(make):
    """What ``make`` returns, and the bytes that it keeps and that it had at most."""
    tracemalloc.start()
    try:
        made = make()
        return made, *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_a_workers_tables_are_small():
    with open(tokenizer_path(), encoding="utf-8") as f:
        config = f.read()
    assert traced(lambda: trie_bpe.Encoder(config))[1] < 36e6


def test_only_a_slice_of_a_batch_is_in_python(own, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "SLICE", 1 << 14)
    texts = [f"text {i % 5} " + "word " * 2000 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["text"])
    list(trie_bpe.coded(own, iter([batch]), "text", ["text", "ids"], False))
    lengths, _, most = traced(lambda: [n for out in trie_bpe.coded(own, iter([batch]), "text", ["text", "ids"], False) for n in out.column("ids").value_lengths().to_pylist()])
    assert lengths == [len(e.ids) for e in library.encode_batch([*texts, ""], add_special_tokens=False)]
    assert most < batch.nbytes / 3


def test_unused_arrow_memory_is_handed_back(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append("back")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(handing_back(lambda batches: (calls.append(x) or x for x in batches))(iter([1, 2]))) == [1, 2]
    assert calls == [1, "back", 2, "back", "back"]


def test_tables_are_encoded_and_decoded(spark, library):
    docs = documents(spark, ODD_ROWS)
    at_once = trie_bpe.encode_documents(docs, tokenizer_path(), decoded="decoded")
    apart = trie_bpe.decode_documents(trie_bpe.encode_documents(docs, tokenizer_path()), tokenizer_path())
    assert set(at_once.columns) == set(docs.columns)
    for frame in (at_once, apart):
        rows = frame.collect()
        assert len(rows) == len(ODD_ROWS)
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.lang == "en"
    assert trie_bpe.encode_documents(spark.createDataFrame([], DOCUMENTS), tokenizer_path(), decoded="d").count() == 0


def blocks_of(spark, files, size):
    """files: {name: [token ids]}."""
    rows = []
    for name, ids in files.items():
        data = np.array(ids, "<u2").tobytes()
        rows += [(name, i // (2 * size), bytearray(data[i:i + 2 * size]), 1) for i in range(0, len(data), 2 * size)]
    return spark.createDataFrame(rows, "file string, block long, data binary, n_tokens int")


def counted(files):
    out = set()
    for name, ids in files.items():
        start, ordinal = 0, 0
        for i, t in enumerate(ids):
            if t == 0:
                out.add((name, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            out.add((name, ordinal, start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("size", [1, 3, 50])
def test_documents_over_block_edges(spark, size):
    random.seed(size)
    files = {f"f{k}": [random.choice([0, 1, 2, 3]) if k else 5 for _ in range(97)] for k in range(4)} | {"all": [0] * 9, "end": [4, 0], "none": []}
    got = separator_scan.document_counts(blocks_of(spark, files, size), 0)
    rows = [(r.file, r.ordinal, r.first_token, r.n_tokens, r.closed) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == counted(files)


def test_odd_blocks(spark):
    rows = [("a", 0, bytearray(b"\1\0\0\0"), 1), ("a", 0, bytearray(b"\1\0\0\0"), 1), ("a", 1, None, 1), (None, 0, bytearray(b"\1\0"), 1), ("b", None, None, 1), ("c", 0, bytearray(), 1)]
    frame = spark.createDataFrame(rows, "file string, block long, data binary, ordinal int")
    assert [tuple(r) for r in separator_scan.document_counts(frame, 0).collect()] == [("a", 0, 0, 1, True)]
    assert separator_scan.document_counts(frame.limit(0), 0).count() == 0


def test_flat_files_are_read_in_blocks(spark, tmp_path):
    ids = [1, 2, 0, 3, 0, 0, 4, 5, 6, 7, 0]
    (tmp_path / "x.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = separator_scan.document_counts(separator_scan.read_token_files(spark, str(tmp_path / "*.bin"), block_tokens=4), 0).collect()
    assert sorted((r.ordinal, r.first_token, r.n_tokens) for r in got) == [(0, 0, 2), (1, 3, 1), (2, 5, 0), (3, 6, 4)]


@pytest.mark.parametrize("width,extra", [(2, b"\x07"), (4, b"\x01\x02\x03")])
def test_bytes_after_the_last_token_are_none(spark, tmp_path, width, extra):
    ids = [1, 2, 0, 3, 70_000 if width == 4 else 9, 0, 5]
    (tmp_path / "x.bin").write_bytes(np.array(ids, f"<u{width}").tobytes() + extra)
    (tmp_path / "y.bin").write_bytes(extra)
    (tmp_path / "z.bin").write_bytes(b"")
    for size in (2, 100):
        ranges = separator_scan.read_token_files(spark, str(tmp_path / "*.bin"), block_tokens=size, token_bytes=width)
        got = separator_scan.document_counts(ranges, 0, token_bytes=width).collect()
        assert sorted((r.ordinal, r.first_token, r.n_tokens, r.closed) for r in got) == [(0, 0, 2, True), (1, 3, 2, True), (2, 6, 1, False)]
    data = spark.createDataFrame([("a", 0, bytearray(b"\1\0\0\0\5"))], "file string, block long, data binary")
    assert [(r.n_tokens, r.closed) for r in separator_scan.document_counts(data, 0).collect()] == [(1, True)]


def test_a_file_of_any_size_is_cut_into_ranges(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((5 << 30) + 1)  # sparse
    ranges = separator_scan.read_token_files(spark, str(tmp_path / "large.bin"), block_tokens=1 << 28)
    assert sorted((r.block, r.start, r.size) for r in ranges.collect()) == [(i, i << 29, 1 << 29) for i in range(10)]


def test_ids_must_fit_the_width(spark):
    with pytest.raises(ValueError):
        separator_scan.write_token_files(documents(spark, ODD_ROWS), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_DOCUMENT, token_bytes=1)


def test_files_stay_in_a_given_folder(spark, tmp_path):
    docs = documents(spark, ODD_ROWS)
    for width in (2, 4):
        folder = tmp_path / f"w{width}"
        args = (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_DOCUMENT)
        ranges, _ = separator_scan.write_token_files(docs, *args, token_bytes=width, folder=str(folder))
        again = separator_scan.read_token_files(spark, f"{folder}/*.bin", token_bytes=width)
        counts = [sorted(r.n_tokens for r in separator_scan.document_counts(x, END_OF_DOCUMENT, token_bytes=width).collect()) for x in (ranges, again)]
        assert counts[0] == counts[1] and len(counts[0]) == len(ODD_ROWS)
    empty = separator_scan.write_token_files(spark.createDataFrame([], DOCUMENTS), *args)
    assert [x.count() for x in empty] == [0, 0]


def test_written_token_files(spark):
    docs = documents(spark, ODD_ROWS)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blocks, which = separator_scan.write_token_files(docs, path, public_tokenizers.PATTERN, END_OF_DOCUMENT, block_tokens=64)
    got = separator_scan.document_counts(blocks, END_OF_DOCUMENT).join(which, ["file", "ordinal"]).collect()
    want = sorted((str(i), len(encode(t or ""))) for i, t, *_ in ODD_ROWS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
