"""On-page SEO fields from HTML as column expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.text import (
    EXCERPT_CHARS,
    WHITESPACE,
    array_top,
    as_col,
    blank_to_null,
    clip,
    collapse_ws,
    empty_to_null,
    let,
    trim_ws,
)
from sitetide.functions.urls import resolve_url

H2_STORED = 30
NOT_A_WORD = "(?![A-Za-z0-9_])"

# The named entities that are decoded; all others stay as written.
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

# Blocks that never show as text, and page chrome that is not content.
HIDDEN_BLOCKS = "script|style|noscript|svg|template"
CHROME_BLOCKS = "nav|footer|header"

# Numeric references no character exists for: capital X, a leading hex letter, or beyond U+10FFFF.
_BAD_REFERENCE = (
    "&#(?:X[0-9A-Fa-f]+"
    "|[A-Fa-f][0-9A-Fa-f]*"
    "|x0*+(?:[0-9A-Fa-f]{7,}|[2-9A-Fa-f][0-9A-Fa-f]{5}|1[1-9A-Fa-f][0-9A-Fa-f]{4})"
    "|0*+(?:[0-9]{8,}|[2-9][0-9]{6}|1[2-9][0-9]{5}|11[2-9][0-9]{4}|111[5-9][0-9]{3}"
    "|1114[2-9][0-9]{2}|11141[2-9][0-9]|111411[2-9])(?:[A-Fa-f][0-9A-Fa-f]*)?);"
)

ERROR_ENTITY = "Invalid code point"
ERROR_URL = "Invalid URL"


def has_bad_reference(col: Column | str) -> Column:
    return as_col(col).rlike(_BAD_REFERENCE)


def _character(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(token: Column) -> Column:
    def read(digits: Column) -> Column:
        return F.when(
            F.startswith(digits, F.lit("x")), F.conv(F.substring(digits, 2, 1 << 20), 16, 10)
        ).otherwise(F.regexp_extract(digits, "^[0-9]+", 0)).cast("bigint")

    body = F.regexp_extract(token, "^&#(x[0-9A-Fa-f]+|[0-9]+[0-9A-Fa-f]*);$", 1)
    return let(body, lambda b: F.when(F.length(b) > 0, _character(read(b))).otherwise(token))


def _decode_token(token: Column) -> Column:
    whole = F.startswith(token, F.lit("&")) & F.endswith(token, F.lit(";"))

    def named(lowered: Column) -> Column:
        out = F.when(F.startswith(lowered, F.lit("&#")), _numeric(token))
        for entity, text in NAMED_ENTITIES.items():
            out = out.when(lowered == f"&{entity};", F.lit(text))
        return out.otherwise(token)

    return F.when(whole, let(F.lower(token), named)).otherwise(token)


def decode_entities(col: Column | str) -> Column:
    """One pass over all references; null when one of them has no character.

    Text with lower-case named references only takes plain replacements: none of their results can
    form a new reference as long as the ampersand comes last. Other text is cut at the reference borders.
    """
    text = as_col(col)
    decoded = F.array_join(F.transform(F.split(text, "(?=&)|(?<=;)", -1), _decode_token), "")
    simple = text
    for entity in [e for e in NAMED_ENTITIES if e != "amp"] + ["amp"]:
        simple = F.replace(simple, F.lit(f"&{entity};"), F.lit(NAMED_ENTITIES[entity]))
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(~text.rlike("&(?:#|[A-Z]|[a-z]+[A-Z])"), simple)
        .when(~has_bad_reference(text), decoded)
    )


def _decoded(raw: Column) -> Column:
    """Decoded text, null when blank; ``raw`` and the decoding are evaluated once even inside lambdas."""
    decoded = F.transform(F.array(raw), decode_entities)
    return F.get(F.filter(decoded, lambda v: F.length(v) > 0), F.lit(0))


def strip_tags(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), "<[^>]+>", " ")


def normalize_text(col: Column | str) -> Column:
    return collapse_ws(let(as_col(col), decode_entities))


def raw_tag_text(html: Column | str, tag: str) -> Column:
    pattern = f"(?is)<{tag}{NOT_A_WORD}[^>]*>(.*?)</{tag}>"
    return F.transform(F.regexp_extract_all(as_col(html), F.lit(pattern), F.lit(1)), strip_tags)


def _tidy(texts: Column) -> Column:
    return F.filter(F.transform(texts, normalize_text), lambda t: F.length(t) > 0)


def all_tag_text(html: Column | str, tag: str, limit: int | None = None) -> Column:
    """Non-empty cleaned texts of every ``tag`` element, in page order."""
    texts = _tidy(raw_tag_text(html, tag))
    return texts if limit is None else array_top(texts, limit)


def first_tag_text(html: Column | str, tag: str) -> Column:
    return F.get(all_tag_text(html, tag), F.lit(0))


def raw_attribute(tag: Column | str, name: str) -> Column:
    source = as_col(tag)
    pattern = (
        f"(?i)(?<![A-Za-z0-9_]){name}[{WHITESPACE}]*=[{WHITESPACE}]*"
        f"(?:[\"']([^\"']*)[\"']|([^{WHITESPACE}>]+))"
    )
    quoted = F.regexp_extract(source, pattern, 1)
    return trim_ws(F.when(F.length(quoted) > 0, quoted).otherwise(F.regexp_extract(source, pattern, 2)))


def attribute(tag: Column | str, name: str) -> Column:
    return _decoded(raw_attribute(tag, name))


def _tags(html: Column | str, tag: str) -> Column:
    return F.regexp_extract_all(as_col(html), F.lit(f"(?i)<{tag}{NOT_A_WORD}[^>]*>"), F.lit(0))


def _meta_tag(html: Column | str, name: str) -> Column:
    return F.get(F.filter(_tags(html, "meta"), lambda t: F.lower(attribute(t, "name")) == name), F.lit(0))


def meta_content(html: Column | str, name: str) -> Column:
    """Content of the first ``<meta>`` of that name, even when a later one has more to say."""
    return attribute(_meta_tag(html, name.lower()), "content")


def _link_tag(html: Column | str, rel: str) -> Column:
    def matches(tag: Column) -> Column:
        tokens = F.split(F.lower(attribute(tag, "rel")), f"[{WHITESPACE}]+", -1)
        return F.coalesce(F.array_contains(tokens, rel), F.lit(False))

    return F.get(F.filter(_tags(html, "link"), matches), F.lit(0))


def link_href(html: Column | str, rel: str) -> Column:
    return attribute(_link_tag(html, rel.lower()), "href")


def html_lang(html: Column | str) -> Column:
    pattern = (
        f"(?i)<html{NOT_A_WORD}[^>]*(?<![A-Za-z0-9_])lang[{WHITESPACE}]*=[{WHITESPACE}]*[\"']([^\"']+)[\"']"
    )
    return empty_to_null(F.regexp_extract(as_col(html), pattern, 1))


def _without_blocks(html: Column, names: str) -> Column:
    return F.regexp_replace(html, rf"(?is)<({names}){NOT_A_WORD}.*?</\1>", " ")


def raw_visible_text(html: Column | str) -> Column:
    return strip_tags(_without_blocks(_without_blocks(as_col(html), HIDDEN_BLOCKS), CHROME_BLOCKS))


def visible_text(html: Column | str) -> Column:
    return normalize_text(raw_visible_text(html))


def content_excerpt(html: Column | str, max_chars: int | None = None) -> Column:
    return blank_to_null(clip(visible_text(html), max_chars))


SEO_FIELDS = [
    "title",
    "meta_description",
    "h1",
    "h2",
    "canonical_url",
    "robots_meta",
    "page_language",
    "content_excerpt",
]


def extract_seo(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    max_chars: int | None = None,
    max_h2: int | None = None,
) -> DataFrame:
    """Append the SEO fields and ``seo_error`` (null when every field could be read).

    With ``max_chars`` and ``max_h2`` only so many characters of the text and so many headings are kept.

    Three row-local projections: find the raw pieces, check and clean them, settle the outcome.
    A character reference nobody can decode or a canonical link that cannot be resolved fails the
    whole page, as one error per page.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    found = pages.withColumns(
        {
            "_titles": raw_tag_text(body, "title"),
            "_h1s": raw_tag_text(body, "h1"),
            "_h2s": raw_tag_text(body, "h2"),
            "_metas": F.transform(
                _tags(body, "meta"),
                lambda t: F.struct(
                    raw_attribute(t, "name").alias("name"), raw_attribute(t, "content").alias("content")),
            ),
            "_links": F.transform(
                _tags(body, "link"),
                lambda t: F.struct(raw_attribute(t, "rel").alias("rel"), raw_attribute(t, "href").alias("href")),
            ),
            "_text": raw_visible_text(body),
            "page_language": html_lang(body),
        }
    )

    def is_meta(name: str) -> Callable[[Column], Column]:
        return lambda m: F.coalesce(F.lower(_decoded(m["name"])) == name, F.lit(False))

    def first_meta(name: str) -> Column:
        return F.get(F.filter(F.col("_metas"), is_meta(name)), F.lit(0))

    def up_to_first(texts: Column, found: Column) -> Column:
        """The texts that a search from the front reads: up to the first one found, all if there is none."""
        at = F.coalesce(F.array_position(found, True), F.lit(0))
        return F.slice(texts, F.lit(1), F.when(at == 0, F.size(texts)).otherwise(at).cast("int"))

    def is_canonical(link: Column) -> Column:
        tokens = F.split(F.lower(_decoded(link["rel"])), f"[{WHITESPACE}]+", -1)
        return F.coalesce(F.array_contains(tokens, "canonical"), F.lit(False))

    picked = found.withColumns(
        {
            "_description": first_meta("description")["content"],
            "_robots": first_meta("robots")["content"],
            "_canonical": F.get(F.filter(F.col("_links"), is_canonical), F.lit(0))["href"],
        }
    ).withColumn("_href", _decoded(F.col("_canonical")))

    def any_bad(texts: Column) -> Column:
        return F.exists(texts, has_bad_reference)

    bad_reference = (
        any_bad(F.col("_titles")) | any_bad(F.col("_h1s")) | any_bad(F.col("_h2s"))
        | F.coalesce(has_bad_reference("_description"), F.lit(False))
        | F.coalesce(has_bad_reference("_robots"), F.lit(False))
        | F.coalesce(has_bad_reference("_canonical"), F.lit(False))
        | any_bad(up_to_first(F.transform("_metas", lambda m: m["name"]), F.transform("_metas", is_meta("description"))))
        | any_bad(up_to_first(F.transform("_metas", lambda m: m["name"]), F.transform("_metas", is_meta("robots"))))
        | any_bad(up_to_first(F.transform("_links", lambda m: m["rel"]), F.transform("_links", is_canonical)))
        | has_bad_reference("_text")
    )
    cleaned = picked.withColumns(
        {
            "title": F.get(_tidy(F.col("_titles")), F.lit(0)),
            "h1": F.get(_tidy(F.col("_h1s")), F.lit(0)),
            "h2": array_top(_tidy(F.col("_h2s")), max_h2),
            "meta_description": _decoded(F.col("_description")),
            "robots_meta": _decoded(F.col("_robots")),
            "canonical_url": F.when(F.col("_href").isNotNull(), resolve_url("_href", url)),
            "content_excerpt": blank_to_null(clip(normalize_text("_text"), max_chars)),
            "_bad": bad_reference,
        }
    )
    error = F.when(F.col("_bad"), F.lit(ERROR_ENTITY)).when(
        F.col("_href").isNotNull() & F.col("canonical_url").isNull(), F.lit(ERROR_URL))
    scratch = ["_titles", "_h1s", "_h2s", "_metas", "_links", "_text", "_description", "_robots", "_canonical",
               "_href", "_bad"]
    return cleaned.withColumn("seo_error", error).drop(*scratch)


def blank_seo(df: DataFrame, keep: Column) -> DataFrame:
    """Null out every SEO field (empty list for ``h2``) on rows where ``keep`` does not hold."""
    empty = F.array().cast("array<string>")
    kept = F.coalesce(keep, F.lit(False))
    return df.withColumns(
        {
            name: F.when(kept, F.col(name)).otherwise(empty if name == "h2" else F.lit(None).cast("string"))
            for name in SEO_FIELDS
        }
    )
