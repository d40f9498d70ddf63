"""Analysis input, response, validation and outcome queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitetide.functions.jsons import safe_json
from sitetide.functions.text import EXCERPT_CHARS
from sitetide.operators import analysis as A
from sitetide.queries import inputs as I
from sitetide.queries.registry import query
from sitetide.schemas import conform


def now():
    return F.lit(I.AS_OF).cast("timestamp")


def doc_pages(spark, sf):
    did = F.col("doc_id")
    docs = I.read(spark, sf, "documents")
    pages = docs.select(
        did.cast("string").alias("id"), F.concat(F.lit("https://docs.example.com/"), F.col("source"), F.lit("/"), did.cast("string")).alias("current_url"))
    seo = conform(docs.select(
        did.cast("string").alias("page_id"), F.concat(F.lit("Doc "), did.cast("string")).alias("title"),
        F.array_repeat(F.lit("h"), (did % 40).cast("int")).alias("h2"), F.col("lang").alias("page_language"), F.col("text").alias("content_excerpt"),
        F.when(did % 10 == 0, F.lit("failed")).otherwise(F.lit("success")).alias("fetch_status"), now().alias("updated_at")), "page_seo_data")
    return pages, seo


@query("analysis_payload", """
SELECT CAST(doc_id AS VARCHAR) AS page_id, (doc_id % 40)::BIGINT AS h2_count, md5(text) AS excerpt_md5 FROM documents WHERE doc_id % 10 <> 0""")
def analysis_payload(spark, sf):
    """The payload without limits: all headings and the whole text."""
    read = F.from_json("payload", "h2 array<string>, contentExcerpt string")
    return A.analysis_input(*doc_pages(spark, sf)).withColumn("p", read).select(
        "page_id", F.size("p.h2").cast("bigint").alias("h2_count"), F.md5("p.contentExcerpt").alias("excerpt_md5"))


@query("analysis_input", """
SELECT CAST(doc_id AS VARCHAR) AS page_id, 'https://docs.example.com/' || source || '/' || doc_id AS url, 'Doc ' || doc_id AS title, NULL::VARCHAR AS h1,
  least(doc_id % 40, 20)::BIGINT AS h2_count, lang AS page_language, md5(substr(text, 1, 8000)) AS excerpt_md5 FROM documents WHERE doc_id % 10 <> 0""")
def analysis_input(spark, sf):
    inputs = A.analysis_input(*doc_pages(spark, sf), max_h2=A.H2_SENT, max_chars=EXCERPT_CHARS)
    read = F.from_json("payload", "url string, title string, h1 string, h2 array<string>, pageLanguage string, contentExcerpt string")
    return inputs.withColumn("p", read).select(
        "page_id", F.col("p.url").alias("url"), F.col("p.title").alias("title"), F.col("p.h1").alias("h1"), F.size("p.h2").cast("bigint").alias("h2_count"),
        F.col("p.pageLanguage").alias("page_language"), F.md5("p.contentExcerpt").alias("excerpt_md5"))


def landed_answers(spark, sf):
    """Chat responses built from the documents: text, parts, error, no content, broken JSON, oversized."""
    did = F.col("doc_id")
    text = F.to_json(F.array(F.trim("text")))
    quoted = F.substring(text, F.lit(2), F.length(text) - 2)
    body = (
        F.when(did % 7 == 1, F.concat(F.lit('{"choices":[{"message":{"content":[{"text":'), quoted, F.lit('},{"type":"x"},{"text":"!"}]}}]}')))
        .when(did % 7 == 2, F.lit('{"error":{"message":"quota"}}'))
        .when(did % 7 == 3, F.lit('{"choices":[]}'))
        .when(did % 7 == 4, F.lit('{"choices":'))
        .when(did % 7 == 5, F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), 256_000), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), quoted, F.lit("}}]}")))
    )
    return I.read(spark, sf, "documents").select(
        did, body.alias("body"), F.when(did % 7 == 2, 429).when(did % 7 == 6, 500).otherwise(200).alias("http_status"))


@query("analysis_response", f"""
WITH t AS (SELECT doc_id, trim(text) AS x FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^{I.SPACES}+', ''), '{I.SPACES}+$', '') AS x,
  regexp_replace(x, '^{I.SPACES}+', '') AS l FROM t)
SELECT doc_id, md5(CASE doc_id % 7 WHEN 0 THEN x WHEN 1 THEN l || '!' END) AS content_md5,
  CASE doc_id % 7 WHEN 2 THEN 'quota' WHEN 3 THEN '{A.NO_CONTENT}' WHEN 4 THEN 'Invalid JSON' WHEN 5 THEN 'Response exceeds 256000 bytes' WHEN 6 THEN 'OpenRouter returned HTTP 500' END AS error
FROM s""")
def analysis_response(spark, sf):
    read = landed_answers(spark, sf).withColumn("r", A.analysis_content("body", "http_status", A.RESPONSE_MAX_BYTES))
    return read.select("doc_id", F.md5("r.content").alias("content_md5"), F.col("r.error").alias("error"))


def result_texts(spark, sf):
    """Result texts built from the documents, each breaking other rules."""
    did = F.col("doc_id")
    return I.read(spark, sf, "documents").select(did, F.when(did % 17 == 0, F.lit("{oops")).otherwise(safe_json(
        pageType=F.when(did % 3 == 0, F.lit("homepage")).otherwise(F.lit("blog")),
        primaryTopic=F.when(did % 2 == 0, F.col("text")).otherwise(F.col("source")),
        primaryKeyword=F.lit("k"),
        secondaryKeywords=F.array_repeat(F.lit("s"), (did % 18).cast("int")),
        searchIntent=F.lit("mixed"),
        productLine=F.when(did % 2 == 0, F.lit("line")),
        summary=F.when(did % 5 != 0, F.lit("fine")),
        reasoningEvidence=F.array_repeat(F.lit("e"), (did % 10).cast("int")),
        confidence=did % 12 / 10.0,
    )).alias("content"))


@query("analysis_validate", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'json' ELSE concat_ws(',',
  CASE WHEN doc_id % 3 = 0 THEN 'pageType' END, CASE WHEN length(CASE WHEN doc_id % 2 = 0 THEN text ELSE source END) NOT BETWEEN 1 AND 200 THEN 'primaryTopic' END,
  CASE WHEN doc_id % 18 > 15 THEN 'secondaryKeywords' END, CASE WHEN doc_id % 5 = 0 THEN 'summary' END,
  CASE WHEN doc_id % 10 NOT BETWEEN 1 AND 8 THEN 'reasoningEvidence' END, CASE WHEN doc_id % 12 > 10 THEN 'confidence' END) END AS violations FROM documents)
SELECT doc_id, violations = '' AS is_valid, violations, CASE WHEN violations = '' THEN doc_id % 12 / 10.0 END::DOUBLE AS confidence FROM r""")
def analysis_validate(spark, sf):
    checked = result_texts(spark, sf).withColumn("c", A.validate_analysis("content"))
    return checked.select(
        "doc_id", F.col("c.is_valid").alias("is_valid"), F.array_join("c.violations", ",").alias("violations"), F.col("c.result.confidence").alias("confidence"))


VALID = "doc_id % 17 <> 0 AND doc_id % 3 <> 0 AND length(CASE WHEN doc_id % 2 = 0 THEN text ELSE source END) BETWEEN 1 AND 200 AND doc_id % 18 <= 15 AND doc_id % 5 <> 0 AND doc_id % 10 BETWEEN 1 AND 8 AND doc_id % 12 <= 10"


def _outcomes(spark, sf):
    inputs = I.read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("scan_"), (F.col("doc_id") % 4).cast("string")).alias("scan_run_id"))
    answers = result_texts(spark, sf).filter(F.col("doc_id") % 19 != 0).select(
        F.col("doc_id").cast("string").alias("page_id"), F.lit(200).alias("http_status"),
        F.to_json(F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))).alias("body"))
    return A.analysis_outcomes(inputs, answers, now(), model="m"), inputs


@query("analysis_outcome", f"""
SELECT CAST(doc_id AS VARCHAR) AS page_id, CASE WHEN doc_id % 19 <> 0 AND {VALID} THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN doc_id % 19 <> 0 AND {VALID} THEN 'blog' END AS page_type, CASE WHEN NOT (doc_id % 19 <> 0 AND {VALID}) THEN 'AI_REQUEST_FAILED' END AS error_code FROM documents
UNION ALL SELECT 'skipped', 'skipped', NULL, 'AI_NOT_CONFIGURED' FROM documents""")
def analysis_outcome(spark, sf):
    out, inputs = _outcomes(spark, sf)
    skipped = A.analysis_outcomes(inputs, None, now()).withColumn("page_id", F.lit("skipped"))
    return out.unionByName(skipped).select("page_id", "status", "page_type", "error_code")


@query("analysis_events", f"""
SELECT CAST(doc_id AS VARCHAR) AS page_id, 'scan_' || doc_id % 4 AS scan_run_id, CASE WHEN doc_id % 19 <> 0 AND {VALID} THEN 'analysis_succeeded' ELSE 'analysis_failed' END AS event_type FROM documents""")
def analysis_events(spark, sf):
    return A.analysis_events(_outcomes(spark, sf)[0], now()).select("page_id", "scan_run_id", "event_type")


@query("pipeline_counters", f"""
SELECT 'scan_' || doc_id % 4 AS scan_run_id, count(*) FILTER (doc_id % 6 <> 0) AS fetch_success_count, count(*) FILTER (doc_id % 6 = 0) AS fetch_failed_count,
  count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 19 <> 0 AND {VALID}) AS analysis_success_count,
  count(*) FILTER (doc_id % 6 <> 0 AND NOT (doc_id % 19 <> 0 AND {VALID})) AS analysis_failed_count FROM documents GROUP BY 1""")
def pipeline_counters(spark, sf):
    out, inputs = _outcomes(spark, sf)
    status = F.when(F.col("page_id").cast("bigint") % 6 == 0, F.lit("unsupported")).otherwise(F.lit("success"))
    fetches = inputs.withColumn("fetch_status", status)
    analyzed = out.filter(F.col("page_id").cast("bigint") % 6 != 0)
    return A.pipeline_counters(fetches, analyzed)


@query("analyze_rules", """
SELECT CAST(doc_id AS VARCHAR) AS page_id, 'other' AS page_type, 'doc ' || doc_id AS primary_keyword, least(doc_id % 40, 15)::BIGINT AS keywords FROM documents WHERE doc_id % 10 <> 0""")
def analyze_rules(spark, sf):
    inputs = A.analysis_input(*doc_pages(spark, sf))
    answers = A.read_responses(A.analyze(inputs, A.rule_provider))
    return answers.select(
        "page_id", F.col("result.page_type").alias("page_type"), F.col("result.primary_keyword").alias("primary_keyword"),
        F.size("result.secondary_keywords").cast("bigint").alias("keywords"))
