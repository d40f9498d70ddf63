"""Structured page analysis: request payloads, response reading, validation, outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.jsons import safe_json, string_items
from sitetide.functions.text import (
    ANALYSIS_ERROR_CHARS,
    RAW_RESPONSE_CHARS,
    array_top,
    as_col,
    blank_to_null,
    clip,
    let,
    make_id,
    trim_ws,
)
from sitetide.operators.lifecycle import append_events, new_events
from sitetide.schemas import conform
from sitetide.sources.tables import size_error

# Fixed value: the headings that a paid analyzer is sent.
H2_SENT = 20
RESPONSE_MAX_BYTES = 256_000
# Messages stored with failed or skipped analyses.
NO_CONTENT = "OpenRouter response did not contain message content"
BAD_JSON = "Invalid JSON"
BAD_RESPONSE = "Response does not have the expected types"
NOT_CONFIGURED = "OPENROUTER_API_KEY is not configured"

# The closed sets of the result schema.
PAGE_TYPES = [
    "product", "product_category", "solution", "industry", "blog", "guide", "case_study", "landing_page", "other",
]
SEARCH_INTENTS = ["informational", "commercial", "transactional", "navigational", "mixed"]

# Result field -> state-table column.
TEXT_FIELDS = {
    "pageType": "page_type",
    "primaryTopic": "primary_topic",
    "primaryKeyword": "primary_keyword",
    "searchIntent": "search_intent",
    "productLine": "product_line",
    "summary": "summary",
}


def analyzable(seo: DataFrame) -> DataFrame:
    return seo.filter(F.col("fetch_status") == "success")


def analysis_input(
    pages: DataFrame, seo: DataFrame, retry_number: int = 0, max_h2: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """(page_id, payload): what an analyzer gets to see of every successfully fetched page; with ``max_h2`` and ``max_chars``
    only so many headings and characters of the content."""
    left = pages.select(F.col("id").alias("page_id"), F.col("current_url").alias("url"))
    right = analyzable(seo).select(
        "page_id", "title", "meta_description", "h1", "h2", "page_language", "content_excerpt")
    payload = safe_json(
        retryNumber=F.lit(retry_number),
        url=F.col("url"),
        title=F.col("title"),
        metaDescription=F.col("meta_description"),
        h1=F.col("h1"),
        h2=F.coalesce(array_top("h2", max_h2), F.array().cast("array<string>")),
        pageLanguage=F.col("page_language"),
        contentExcerpt=clip("content_excerpt", max_chars),
    )
    return left.join(right, "page_id").select("page_id", payload.alias("payload"))


def analysis_content(body: Column | str, http_status: Column | str, max_bytes: int | None = None) -> Column:
    """struct(content, error): the message text of a chat response, or why there is none."""
    raw, status = as_col(body), as_col(http_status)
    too_long = F.coalesce(F.octet_length(raw) > max_bytes, F.lit(False)) if max_bytes is not None else F.lit(False)

    def is_absent_or(value: Column, kind: str) -> Column:
        return value.isNull() | F.startswith(F.schema_of_variant(value), F.lit(kind))

    def refused(doc: Column) -> Column:
        """Types that the response schema does not allow: objects and lists where they belong, texts as strings."""
        def broken_choice(choice: Column) -> Column:
            content = F.try_variant_get(choice, "$.message.content", "variant")
            kind = F.schema_of_variant(content)
            parts = F.try_variant_get(content, "$", "array<variant>")
            bad_part = F.exists(parts, lambda p: ~F.startswith(F.schema_of_variant(p), F.lit("OBJECT")) | ~is_absent_or(
                F.try_variant_get(p, "$.text", "variant"), "STRING"))
            fits = content.isNull() | (kind == "STRING") | (F.startswith(kind, F.lit("ARRAY")) & ~F.coalesce(bad_part, F.lit(False)))
            return (~F.startswith(F.schema_of_variant(choice), F.lit("OBJECT"))
                    | ~is_absent_or(F.try_variant_get(choice, "$.message", "variant"), "OBJECT") | ~fits)

        choices = F.try_variant_get(doc, "$.choices", "variant")
        failure = F.try_variant_get(doc, "$.error", "variant")
        return (
            ~F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")) | ~is_absent_or(choices, "ARRAY") | ~is_absent_or(failure, "OBJECT")
            | ~is_absent_or(F.try_variant_get(failure, "$.message", "variant"), "STRING")
            | F.coalesce(F.exists(F.try_variant_get(choices, "$", "array<variant>"), broken_choice), F.lit(False)))

    def read(doc: Column) -> Column:
        message = F.try_variant_get(doc, "$.choices[0].message.content", "variant")
        kind = F.schema_of_variant(message)
        parts = F.transform(
            F.try_variant_get(message, "$", "array<variant>"),
            lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        text = (
            F.when(kind == "STRING", F.try_variant_get(message, "$", "string"))
            .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, ""))
        )
        content = blank_to_null(trim_ws(text))
        http_error = ~F.coalesce(status.between(200, 299), F.lit(False))
        error = (
            F.when(too_long, F.lit(size_error(max_bytes)))
            .when(doc.isNull(), F.lit(BAD_JSON))
            .when(F.coalesce(refused(doc), F.lit(False)), F.lit(BAD_RESPONSE))
            .when(http_error, F.coalesce(
                F.try_variant_get(doc, "$.error.message", "string"),
                F.concat(F.lit("OpenRouter returned HTTP "), status.cast("string"))))
            .when(content.isNull(), F.lit(NO_CONTENT))
        )
        return F.struct(F.when(error.isNull(), content).alias("content"), error.alias("error"))

    return let(F.try_parse_json(F.when(~too_long, raw)), read)


def validate_analysis(content: Column | str) -> Column:
    """struct(result, is_valid, violations) of a result text; one broken rule invalidates it all."""

    def check(doc: Column) -> Column:
        def item(name: str) -> Column:
            return F.try_variant_get(doc, f"$.{name}", "variant")

        def kind(name: str) -> Column:
            return F.coalesce(F.schema_of_variant(item(name)), F.lit("MISSING"))

        def text(name: str) -> Column:
            return F.when(kind(name) == "STRING", F.try_variant_get(doc, f"$.{name}", "string"))

        def sized(name: str, low: int, high: int) -> Column:
            return F.coalesce(F.length(text(name)).between(low, high), F.lit(False))

        def listed(name: str, low: int, high: int, longest: int) -> Column:
            items = F.try_variant_get(item(name), "$", "array<variant>")
            strings = string_items(item(name))
            return F.coalesce(
                F.size(items).between(low, high)
                & (F.size(strings) == F.size(items))
                & F.forall(strings, lambda s: F.length(s).between(1, longest)),
                F.lit(False),
            )

        confidence = F.when(
            kind("confidence").rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"),
            F.try_variant_get(doc, "$.confidence", "double"))
        rules = {
            "pageType": F.coalesce(text("pageType").isin(PAGE_TYPES), F.lit(False)),
            "primaryTopic": sized("primaryTopic", 1, 200),
            "primaryKeyword": sized("primaryKeyword", 1, 200),
            "secondaryKeywords": listed("secondaryKeywords", 0, 15, 200),
            "searchIntent": F.coalesce(text("searchIntent").isin(SEARCH_INTENTS), F.lit(False)),
            "productLine": (kind("productLine") == "VOID") | sized("productLine", 0, 200),
            "summary": sized("summary", 1, 1000),
            "reasoningEvidence": listed("reasoningEvidence", 1, 8, 500),
            "confidence": F.coalesce(confidence.between(0.0, 1.0), F.lit(False)),
        }
        broken = F.filter(
            F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda v: v.isNotNull())
        result = F.struct(
            *[text(name).alias(column) for name, column in TEXT_FIELDS.items()],
            string_items(item("secondaryKeywords")).alias("secondary_keywords"),
            string_items(item("reasoningEvidence")).alias("evidence"),
            confidence.alias("confidence"),
        )
        return F.when(doc.isNull(), F.struct(
            F.lit(None).cast(_RESULT_TYPE).alias("result"), F.lit(False).alias("is_valid"),
            F.array(F.lit("json")).alias("violations"),
        )).otherwise(let(broken, lambda v: F.struct(
            F.when(F.size(v) == 0, result).alias("result"), (F.size(v) == 0).alias("is_valid"), v.alias("violations"))))

    return let(F.try_parse_json(as_col(content)), check)


_RESULT_TYPE = (
    "struct<page_type:string,primary_topic:string,primary_keyword:string,search_intent:string,"
    "product_line:string,summary:string,secondary_keywords:array<string>,evidence:array<string>,confidence:double>"
)


def read_responses(responses: DataFrame) -> DataFrame:
    """Landed analyzer responses (page_id, http_status, body) to page_id, content, result, error."""
    read = responses.withColumn("_read", analysis_content("body", "http_status"))
    checked = read.withColumn("_checked", validate_analysis("_read.content"))
    broken = F.concat(F.lit("Invalid analysis: "), F.array_join("_checked.violations", ", "))
    return checked.select(
        "page_id",
        F.col("_read.content").alias("content"),
        F.col("_checked.result").alias("result"),
        F.coalesce(F.col("_read.error"), F.when(~F.col("_checked.is_valid"), broken)).alias("error"),
    )


def analysis_outcomes(
    inputs: DataFrame,
    responses: DataFrame | None,
    as_of: Column,
    provider: str = "openrouter",
    model: str = "",
    prompt_version: str = "v1",
) -> DataFrame:
    """Analysis rows for every input (page_id, scan_run_id); ``responses`` None means no provider is set up."""
    base = inputs.select("page_id", "scan_run_id")
    if responses is None:
        rows = base.select(
            "*", F.lit(None).cast(_RESULT_TYPE).alias("result"), F.lit(None).cast("string").alias("content"),
            F.lit(NOT_CONFIGURED).alias("error"))
        failed_as, code = "skipped", "AI_NOT_CONFIGURED"
    else:
        rows = base.join(read_responses(responses), "page_id", "left").withColumn(
            "error", F.when(F.col("result").isNull(), F.coalesce("error", F.lit("OpenRouter analysis failed"))))
        failed_as, code = "failed", "AI_REQUEST_FAILED"
    ok = F.col("error").isNull()
    named = [F.when(ok, F.col(f"result.{c}")).alias(c) for c in
             [*TEXT_FIELDS.values(), "secondary_keywords", "evidence", "confidence"]]
    out = rows.select(
        make_id("analysis", "page_id", "scan_run_id", as_of.cast("string")).alias("id"),
        "page_id",
        "scan_run_id",
        F.when(ok, F.lit("success")).otherwise(F.lit(failed_as)).alias("status"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(prompt_version).alias("prompt_version"),
        *named,
        F.when(ok, clip("content", RAW_RESPONSE_CHARS)).alias("raw_response_excerpt"),
        F.when(~ok, F.lit(code)).alias("error_code"),
        F.when(~ok, clip("error", ANALYSIS_ERROR_CHARS)).alias("error_message"),
        F.when(ok, as_of).alias("analyzed_at"),
        as_of.alias("created_at"),
    )
    return out


def analysis_events(outcomes: DataFrame, as_of: Column) -> DataFrame:
    ok = F.col("status") == "success"
    kind = F.when(ok, F.lit("analysis_succeeded")).otherwise(F.lit("analysis_failed"))
    value = F.when(~ok, safe_json(status=F.col("status"), message=F.col("error_message")))
    return new_events(outcomes, F.col("page_id"), F.col("scan_run_id"), kind, as_of, value)


def append_analyses(
    analyses: DataFrame, events: DataFrame, outcomes: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """(analyses, events) with the outcomes appended to both logs."""
    return (
        analyses.unionByName(conform(outcomes, "page_analyses")),
        append_events(events, analysis_events(outcomes, as_of)),
    )


PIPELINE_COUNTS = ["fetch_success_count", "fetch_failed_count", "analysis_success_count", "analysis_failed_count"]


def pipeline_counters(fetches: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per scan: fetch and analysis counts. Unsupported pages count as failed fetches; a fetched page without a
    successful analysis (no input, skipped, failed) counts as a failed analysis."""
    fetched = fetches.groupBy("scan_run_id").agg(
        F.count_if(F.col("fetch_status") == "success").alias("fetch_success_count"),
        F.count_if(F.col("fetch_status") != "success").alias("fetch_failed_count"),
    )
    analyzed = analyses.groupBy("scan_run_id").agg(
        F.count_if(F.col("status") == "success").alias("analysis_success_count"))
    joined = fetched.join(analyzed, "scan_run_id", "left").withColumn(
        "analysis_success_count", F.coalesce("analysis_success_count", F.lit(0)))
    return joined.withColumn(
        "analysis_failed_count", F.col("fetch_success_count") - F.col("analysis_success_count"))


#: From payloads (page_id, payload) to landed responses (page_id, http_status, body).
Provider = Callable[[DataFrame], DataFrame]


def batched(ask: Callable[[pd.Series], pd.Series]) -> Provider:
    """A provider from a function over Arrow batches: payload JSON texts to chat-response JSON texts.

    If a batch raises, its rows are asked for one by one; what then raises becomes the error response of that row alone.
    """

    def provider(inputs: DataFrame) -> DataFrame:
        @F.pandas_udf("http_status int, body string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            import json

            def one(payload: str) -> tuple[int, str]:
                try:
                    return 200, ask(pd.Series([payload])).iloc[0]
                except Exception as error:
                    return 500, json.dumps({"error": {"message": str(error)}})

            for payloads in batches:
                try:
                    yield pd.DataFrame({"http_status": 200, "body": ask(payloads).to_numpy()})
                except Exception:
                    yield pd.DataFrame([one(p) for p in payloads], columns=["http_status", "body"])

        return inputs.select("page_id", run("payload").alias("r")).select("page_id", "r.http_status", "r.body")

    return provider


def analyze(inputs: DataFrame, provider: Provider) -> DataFrame:
    """Landed responses (page_id, http_status, body) of an analyzer to the payloads."""
    return provider(inputs.select("page_id", "payload"))


# Page types whose name in a URL path decides, in this order.
RULED_TYPES = ["product", "blog", "guide", "solution"]


def rule_provider(inputs: DataFrame) -> DataFrame:
    """Deterministic analyzer without network, in column expressions: page type from the URL, keyword from the first heading."""
    page = F.from_json("payload", "url string, title string, metaDescription string, h1 string, h2 array<string>")
    path = F.lower("p.url")
    kind = F.coalesce(*[F.when(F.contains(path, F.lit(f"/{t}")), F.lit(t)) for t in RULED_TYPES], F.lit("other"))
    heading = F.substring(F.coalesce(*[blank_to_null(trim_ws(F.col(f"p.{k}"))) for k in ("h1", "title", "url")], F.lit("page")), 1, 200)
    named = F.filter(F.slice("p.h2", 1, 15), lambda h: F.length(h) > 0)
    read = inputs.withColumn("p", page).withColumns({"_kind": kind, "_heading": heading})
    result = safe_json(
        pageType=F.col("_kind"),
        primaryTopic=F.col("_heading"),
        primaryKeyword=F.lower("_heading"),
        secondaryKeywords=F.transform(named, lambda h: F.substring(h, 1, 200)),
        searchIntent=F.when(F.col("_kind") == "product", F.lit("commercial")).otherwise(F.lit("informational")),
        productLine=F.lit(None).cast("string"),
        summary=F.substring(F.coalesce(F.when(F.length("p.metaDescription") > 0, F.col("p.metaDescription")), F.col("_heading")), 1, 1000),
        reasoningEvidence=F.array("_heading"),
        confidence=F.lit(0.5),
    )
    body = F.to_json(F.struct(F.array(F.struct(F.struct(result.alias("content")).alias("message"))).alias("choices")))
    return read.select("page_id", F.lit(200).alias("http_status"), body.alias("body"))
