"""One query per corpus operator, over its whole table, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm import bitsliced_topk, bloom_lm, chat_format, exact_dedup, hard_negatives, license_scan, member_lloyd, mixing, quality_rff, separator_scan, sharding, tensor_minhash, trie_bpe
from sitetide.llm.common import lookup, staged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- 1: mixing -------------------------------------------------------------------------------------------

#: Target weights of the sources; all other sources share MIX_OTHERS.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.05}
MIX_OTHERS = 0.60
MIX_SEED = 29


@query
def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_OTHERS, seed=MIX_SEED)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return mixed.select("doc_id", "source", "n_copies", "copy", "shuffle_key", n_bytes)


_WEIGHT_ROWS = ", ".join([*(f"('{k}', {w!r})" for k, w in MIX_WEIGHTS.items()), f"(NULL, {MIX_OTHERS!r})"])
ORACLES["op1_poisson_mixing"] = f"""
WITH weights(pool, weight) AS (VALUES {_WEIGHT_ROWS}),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    CASE WHEN source IN ({", ".join(f"'{k}'" for k in MIX_WEIGHTS)}) THEN source END AS pool
  FROM documents
),
sums AS (SELECT pool, sum(n_bytes) AS n FROM d GROUP BY pool),
rates AS (
  SELECT s.pool, CASE WHEN s.n = 0 THEN 1.0 ELSE w.weight / (SELECT sum(w2.weight) FROM sums s2
      JOIN weights w2 ON w2.pool IS NOT DISTINCT FROM s2.pool WHERE s2.n > 0) * (SELECT sum(n) FROM sums) / s.n END AS rate
  FROM sums s JOIN weights w ON w.pool IS NOT DISTINCT FROM s.pool
),
means AS (
  SELECT pool, greatest(1, CAST(ceil(rate / {mixing.LARGEST_MEAN}) AS BIGINT)) AS parts,
    rate / greatest(1, CAST(ceil(rate / {mixing.LARGEST_MEAN}) AS BIGINT)) AS mean
  FROM rates WHERE rate > 0
),
terms AS (
  SELECT m.pool, k.k, exp(-m.mean) * CASE WHEN k.k = 0 THEN 1.0 ELSE pow(m.mean, k.k) / gamma(k.k + 1.0) END AS term
  FROM means m, (SELECT unnest(range(0, 60)) AS k) k
),
bounds AS (SELECT pool, k, sum(term) OVER (PARTITION BY pool ORDER BY k) * {mixing.DRAWS}.0 AS bound FROM terms),
draws AS (
  SELECT d.doc_id, d.source, d.n_bytes, d.pool,
    CAST('0x' || substr(md5('{MIX_SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(p.part AS VARCHAR)), 1, 13) AS BIGINT) AS at
  FROM d JOIN means m ON m.pool IS NOT DISTINCT FROM d.pool
  JOIN (SELECT unnest(range(0, 1000)) AS part) p ON p.part < m.parts
),
counted AS (
  SELECT x.doc_id, any_value(x.source) AS source, any_value(x.n_bytes) AS n_bytes, count(*) AS n_copies
  FROM draws x JOIN bounds b ON b.pool IS NOT DISTINCT FROM x.pool AND b.bound <= x.at GROUP BY x.doc_id
)
SELECT doc_id, source, n_copies, copy,
  CAST('0x' || substr(md5('{MIX_SEED + 1}|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key, n_bytes
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
"""


# --- 2: sharding -----------------------------------------------------------------------------------------

N_SHARDS = 40


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read(spark, sf_dir, "documents"), N_SHARDS)
    return sharded.select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- 8: exact duplicates ---------------------------------------------------------------------------------


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.content) AS text_sha256
FROM n JOIN g ON n.content = g.content
"""


# --- 10: chat formatting ---------------------------------------------------------------------------------

#: A conversation made of control strings, formatted with the others.
HARD_TEXT = r"\### Assistant: </turn> ok"


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("r"),
    ).select("conv_id", "r.turn", "r.role", F.lit(HARD_TEXT).alias("text"))
    chats = chat_format.format_conversations(given.unionByName(hard))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescape(cut(s))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(part: str, role: bool = False) -> str:
    out = rf"replace(replace(replace({part}, '\', '\\'), '</turn>', '\e'), '### ', '\h')"
    return rf"replace({out}, ': ', '\c')" if role else out


_CONFLICT = r"regexp_matches({0}, '</turn>|### |\\\\|\\[ehc]')"
ORACLES["op10_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'
),
e AS (
  SELECT *, CASE WHEN {_CONFLICT.format("text")} OR {_CONFLICT.format("role")} OR contains(role, ': ')
    THEN length({_sql_escape("role", True)}) + length({_sql_escape("text")}) ELSE length(role) + length(text) END AS chars
  FROM t
),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum(chars + 14) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


# --- 7: BPE encoding and decoding ------------------------------------------------------------------------


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


@query
def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = trie_bpe.encode_documents(docs, tokenizer_path(), decoded="decoded").drop("text")
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


# --- 9: quality ------------------------------------------------------------------------------------------

#: Documents with a smaller score are predicted to be of low quality.
QUALITY_THRESHOLD = 0.7
HELD_OUT_PART = 2


def id_part(parts: int) -> Column:
    """The part of a document in the contracts' splits: crc32 of the id as text, modulo the number of parts."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality_rff.document_statistics(read(spark, sf_dir, "documents")))
    held_out = F.coalesce(id_part(4) == HELD_OUT_PART, F.lit(False))
    model = quality_rff.fit_statistics(stats, read(spark, sf_dir, "labels"), ~held_out)
    scored = quality_rff.score_statistics(stats, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


# --- 5: language-model scores ----------------------------------------------------------------------------

LM_HELD_OUT_PART = 1


@query
def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_part(5) == LM_HELD_OUT_PART, F.lit(False))
    scored = bloom_lm.score_documents(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 4: near duplicates ----------------------------------------------------------------------------------


@query
def op4_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(read(spark, sf_dir, "documents"))


# --- 3: exact top-k --------------------------------------------------------------------------------------


@query
def op3_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return bitsliced_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLES["op3_bitsliced_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


# --- 6: token counts -------------------------------------------------------------------------------------

#: The end-of-document id of byte_bpe_50k, which its rank file leaves free.
END_OF_DOCUMENT = 50256


@query
def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ranges, which = separator_scan.write_token_files(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_DOCUMENT)
    counts = separator_scan.document_counts(ranges, END_OF_DOCUMENT)
    return counts.join(which, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "first_token", "n_tokens", "closed")


# --- 12: codes of vectors --------------------------------------------------------------------------------


@query
def op12_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = member_lloyd.compress(read(spark, sf_dir, "embeddings"), keep=("vec_id", "label"))
    numbers = ",".join(str(n) for book in packed.codebooks for n in book.ravel().tolist())
    by_label = packed.codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = lookup(by_label.withColumnRenamed("label", "of"), by_label.count())
    code = F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    return packed.codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


def _lloyd_sql() -> str:
    """One pair of steps a round: the nearest entries (n), then the new codebook (c)."""
    apart = "CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = ["""RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(0, 4)) AS p)
),
c0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS INTEGER) AS e, x FROM parts JOIN kept USING (r)
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id, v) <= 256
)"""]
    for i in range(member_lloyd.ROUNDS + 1):
        steps.append(f"""n{i} AS MATERIALIZED (
  SELECT r, p.p, min((d, e)) AS best FROM (SELECT p.r, p.p, c.e, {apart} AS d FROM parts p JOIN c{i} c ON c.p = p.p) p GROUP BY r, p.p
)""")
        if i < member_lloyd.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
      SELECT p, best[2] AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n
      FROM (SELECT n.p, n.best, t.x, unnest(range(1, len(t.x) + 1)) AS j FROM n{i} n JOIN parts t ON t.r = n.r AND t.p = n.p) GROUP BY p, best[2], j
    ) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e
)""")
    last = member_lloyd.ROUNDS
    return f"""WITH {(","  + chr(10)).join(steps)},
coded AS (
  SELECT r, string_agg(lower(format('{{:02x}}', best[2])), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM n{last} GROUP BY r
),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books"""


ORACLES["op12_member_lloyd"] = _lloyd_sql()


# --- 11: licences ----------------------------------------------------------------------------------------

#: The base phrases and their labels.
LICENSE_PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: A label's evidence is n words that stand there exactly; the score is n / (n + this) for the largest n.
SCORE_HALF = 4


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(read(spark, sf_dir, "documents"), LICENSE_PHRASES, license_scan.TEMPLATES)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
    base, every = F.col("phrases"), F.concat("phrases", "templates")
    evidence = F.coalesce(F.array_max(every["words"]), F.lit(0))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"), labels(base).alias("base_labels"), labels(every).alias("labels"),
        (evidence / (evidence + SCORE_HALF)).alias("score"))


def _license_sql() -> str:
    """Places of the phrases by list positions, templates as regular expressions over the words."""
    starts = [" AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split(), 1)) for phrase in LICENSE_PHRASES.values()]
    base = ",\n    ".join(f"list_filter(range(len(w)), lambda i: {test}) AS at{n}" for n, test in enumerate(starts))

    def found(test: str, label: str, n: int) -> str:
        return f"CASE WHEN {test} THEN {{'label': '{label}', 'n': {n}}} END"

    def known(parts: list[str]) -> str:
        return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"

    def joined(parts: list[str]) -> str:
        return f"array_to_string(list_sort(list_transform({known(parts)}, lambda x: x.label)), ',')"

    phrases = [found(f"len(at{n}) > 0", label, len(phrase.split())) for n, (label, phrase) in enumerate(LICENSE_PHRASES.items())]
    regions = {label: license_scan.parse(template) for label, template in license_scan.TEMPLATES.items()}
    whole = [found(f"regexp_matches(line, ' {license_scan.pattern(nodes)}')", label, license_scan.mandatory_words(nodes)) for label, nodes in regions.items()]
    every = f"list_concat({', '.join(f'at{n}' for n in range(len(starts)))})"
    upper, lower = ("".join(chr(c) for c in range(first, first + 26)) for first in (65, 97))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{license_scan.WORD}') AS w FROM documents),
b AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line,
    {base}
  FROM d
),
e AS (SELECT *, list_max(list_transform({known(phrases + whole)}, lambda x: x.n)) AS n FROM b)
SELECT doc_id, n_words, CAST(len({every}) AS BIGINT) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
  {joined(phrases)} AS base_labels, {joined(phrases + whole)} AS labels, coalesce(n, 0) / (coalesce(n, 0) + {SCORE_HALF}.0) AS score
FROM e
"""


ORACLES["op11_license_scan"] = _license_sql()


# --- 13: hard negatives ----------------------------------------------------------------------------------


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).drop("positive_rank")


ORACLES["op13_hard_negatives"] = """
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM w a JOIN w c ON c.r <> a.r AND len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
