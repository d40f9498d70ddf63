"""Token counts of documents in flat token files that have no index.

A token file is a row of fixed-width token ids and nothing else; an end-of-document id closes each document. Files are cut into
byte ranges anywhere; a task seeks to its range and reads it, whatever the file's size. A block is searched at once; documents
inside it are complete. What is open at its edges is stitched: a prefix scan over the blocks' separator counts numbers the
documents, and pieces with one number add up, over as many blocks as a document has.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm.common import batch_slices, goes_at_end, running_offsets, scratch_path, staged
from sitetide.session import ship_package

#: Bytes of a token id (a little-endian number), and tokens of a block.
TOKEN_BYTES, BLOCK_TOKENS = 2, 1 << 18


def _opened(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path or address is in, and its path there."""
    return pyarrow.fs.FileSystem.from_uri(place)


def byte_ranges(files: DataFrame, block_tokens: int = BLOCK_TOKENS, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """(file, block, start, size) of files (file, length): whole tokens; bytes after a file's last whole token are none."""
    tokens = F.floor(F.col("length") / token_bytes)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((tokens - 1) / block_tokens))
    cut = files.filter(tokens > 0).select("file", tokens.alias("tokens"), F.explode(blocks).alias("block"))
    size = F.least(F.lit(block_tokens).cast("long"), F.col("tokens") - F.col("block") * block_tokens)
    return cut.select("file", "block", (F.col("block") * block_tokens * token_bytes).alias("start"), (size * token_bytes).alias("size"))


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """The byte ranges of flat files, such as ``*.bin``; of any size, as only names and lengths are read here."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    return byte_ranges(files, block_tokens, token_bytes)


def document_counts(blocks: DataFrame, separator: int, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """(file, ordinal, first_token, n_tokens, closed): one row per document of each file, from byte ranges (file, block, start,
    size), which the tasks read, or from their content (file, block, data).

    Blocks are numbered from 0 in each file and hold whole tokens of ``token_bytes`` bytes; what is left over at the end of a
    block's content is no token. The separator isn't counted. Tokens after a file's last separator are a document that isn't closed; nothing after it is none.
    Null or empty data has no tokens; a repeated block counts once; rows without file or block are left out; other columns
    are ignored; an empty table gives no rows. What is shuffled is numbers, no tokens.
    """
    ship_package(blocks.sparkSession)
    kind, columns = np.dtype(f"<u{token_bytes}"), ["data"] if "data" in blocks.columns else ["start", "size"]
    given = blocks.filter(F.col("file").isNotNull() & F.col("block").isNotNull()).select("file", F.col("block").cast("long").alias("block"), *columns)

    def contents(batch: pa.RecordBatch) -> Iterator[bytes]:
        if "data" in columns:
            yield from (data.as_py() or b"" for data in batch.column("data"))
            return
        for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
            system, path = _opened(file)
            with system.open_input_file(path) as source:
                yield source.read_at(length, start)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            size = np.zeros(batch.num_rows, np.int64)
            for i, data in enumerate(contents(batch)):
                tokens = np.frombuffer(data[:len(data) // kind.itemsize * kind.itemsize], kind)
                at.append(np.flatnonzero(tokens == separator))
                size[i] = len(tokens)
            n = np.array([len(x) for x in at], np.int64)
            head = np.array([x[0] if len(x) else s for x, s in zip(at, size, strict=True)], np.int64)
            tail = np.array([s - x[-1] - 1 if len(x) else 0 for x, s in zip(at, size, strict=True)], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]), pa.int32())
            inner = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
                     for parts in ([x[:-1] + 1 for x in at], [np.diff(x) - 1 for x in at])]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *map(pa.array, (size, n, head, tail)), *inner], names)

    names = ["file", "block", "size", "separators", "head", "tail", "starts", "counts"]
    found = given.mapInArrow(search, "file string, block long, size long, separators long, head long, tail long, starts array<long>, counts array<long>")
    scanned = staged(found.dropDuplicates(["file", "block"]))
    edges = scanned.select("file", "block", "size", "separators", "head", "tail")
    documents = running_offsets(edges, "block", "separators", "ordinal", ("file",))
    tokens = running_offsets(edges, "block", "size", "first_token", ("file",))
    placed = edges.join(documents, ["file", "block"]).join(tokens, ["file", "block"])
    closes = F.col("separators") > 0
    first = F.struct("ordinal", "first_token", F.col("head").alias("n"), closes.alias("closed"))
    last = F.struct((F.col("ordinal") + F.col("separators")).alias("ordinal"), (F.col("first_token") + F.col("size") - F.col("tail")).alias("first_token"),
                    F.col("tail").alias("n"), F.lit(False).alias("closed"))
    pieces = placed.select("file", F.explode(F.when(closes, F.array(first, last)).otherwise(F.array(first))).alias("p"))
    stitched = pieces.groupBy("file", F.col("p.ordinal").alias("ordinal")).agg(
        F.min("p.first_token").alias("first_token"), F.sum("p.n").alias("n_tokens"), F.max("p.closed").alias("closed"))
    inside = scanned.select("file", "block", "starts", "counts").filter(F.size("counts") > 0).join(
        placed.select("file", "block", "ordinal", "first_token"), ["file", "block"]).select(
        "file", "ordinal", "first_token", F.posexplode(F.arrays_zip("starts", "counts")).alias("i", "d"))
    return stitched.filter("closed OR n_tokens > 0").unionByName(inside.select(
        "file", (F.col("ordinal") + F.col("i") + 1).alias("ordinal"), (F.col("first_token") + F.col("d.starts")).alias("first_token"),
        F.col("d.counts").alias("n_tokens"), F.lit(True).alias("closed")))


def write_token_files(docs: DataFrame, ranks: str, pattern: str, separator: int, text: str = "text", block_tokens: int = BLOCK_TOKENS,
                      token_bytes: int = TOKEN_BYTES, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Flat token files of all texts in ``folder`` (by default one in the shared folder that goes when the driver ends), one for
    each input partition that has rows: their byte ranges, and (file, ordinal, doc_id), which document is which.

    ``ranks``: path of a rank file on the driver. Null and empty texts are documents without tokens; each text ends with the
    separator; repeated rows and ids are documents of their own; other columns are ignored; an empty table writes no file.
    A repeated task writes a file of another name; only the files of tasks that finished are in the result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = np.dtype(f"<u{token_bytes}")
    sent = spark.sparkContext.broadcast(Path(ranks).read_text(encoding="ascii"))
    if max([separator, *(int(line.split()[1]) for line in sent.value.splitlines())]) > np.iinfo(kind).max:
        raise ValueError(f"ids do not fit {token_bytes} bytes")
    place = folder or scratch_path(spark) + "-tokens"
    names = ["file", "length", "first", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(t): int(i) for t, i in map(str.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        task = TaskContext.get()
        file = f"{place}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"

        def row(length: int | None, first: int | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([file]), pa.array([length], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names)

        out, length, ordinal = None, 0, 0
        try:
            for batch in batches:
                texts = batch.column(text)
                starts = np.concatenate([[0], np.cumsum([len(x or "") for x in texts.to_pylist()])])
                for a, b in batch_slices(starts):
                    if out is None:
                        system, path = _opened(place)
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{file.rsplit('/', 1)[1]}")
                    for x in texts.slice(a, b - a).to_pylist():
                        data = np.array([*encode(x or ""), separator], kind).tobytes()
                        out.write(data)
                        length += len(data)
                    yield row(None, ordinal, batch.column("doc_id").slice(a, b - a).to_pylist())
                    ordinal += b - a
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield row(length, None, None)

    made = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "file string, length long, first long, ids array<long>"))
    if folder is None:
        goes_at_end(spark, place)
    which = made.filter("ids IS NOT NULL").select("file", "first", F.posexplode("ids").alias("i", "doc_id"))
    ranges = byte_ranges(made.filter("length IS NOT NULL").select("file", "length"), block_tokens, token_bytes)
    return ranges, which.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
