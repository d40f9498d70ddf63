"""From raw documents to encoded training rows: the stages, in order, each over all that the one before kept.

All stages take the columns of documents by name, whatever others there are, and an empty table gives an empty one. Null and
empty texts are documents with an empty text; null ids are documents of their own; repeated rows are repeated documents
until the exact duplicates go. Whole texts are read, of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm import exact_dedup, mixing, quality_rff, tensor_minhash, trie_bpe
from sitetide.llm.common import staged
from sitetide.llm.queries import MIX_OTHERS, MIX_SEED, MIX_WEIGHTS, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with a smaller score goes. A kept document costs less than a lost one, so it is below the classifier's 0.7.
REJECTED_BELOW = 0.5
#: Similarity from which the stage takes documents for near duplicates, in hundredths; op4's own contract is 85.
NEAR_DUPLICATES_FROM = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels of these documents, does not reject; all if none is labelled.

    A null label teaches nothing; empty texts are scored like others; each of several equal rows is decided alike."""
    docs = docs.select(COLUMNS)
    model = quality_rff.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality_rff.score_documents(docs, model, score="_score").filter(F.col("_score") >= REJECTED_BELOW).select(COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id.

    Null and empty texts are one group; a null id stays only where its group has no other; of repeated rows one stays."""
    return exact_dedup.drop_duplicates(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Texts without words and rows without id are near to nothing and stay."""
    return tensor_minhash.drop_near_duplicates(docs.select(COLUMNS), NEAR_DUPLICATES_FROM)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled.

    A null source is one of those without a weight of their own; null ids draw as one id; empty texts repeat like the rest of their source."""
    return mixing.mix_sources(docs.select(COLUMNS), MIX_WEIGHTS, MIX_OTHERS, seed=MIX_SEED).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training rows: doc_id, lang, source, n_tokens, ids, and the digest of what the ids decode to; an empty text has no ids."""
    coded = trie_bpe.encode_documents(docs.select(COLUMNS), tokenizer_path(), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("source_mixing", mix), ("bpe_encoding", encode),
]

#: The classifier, the confirmation of near duplicates and the encoder are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs)
    return docs
