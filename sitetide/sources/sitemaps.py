"""Sitemap XML, robots.txt and common-path scans over landed responses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitetide.functions.html import decode_entities as decode_text_entities
from sitetide.functions.text import WHITESPACE, blank_to_null, let, trim_ws
from sitetide.functions.urls import canonical_url, inspect_url
from sitetide.sources.tables import too_large

UNSUPPORTED_XML = "Unsupported Sitemap XML: expected urlset or sitemapindex"
# The sizes that a live crawler reads of a robots.txt and of a response at a common path.
ROBOTS_MAX_BYTES = 250_000
PREVIEW_MAX_BYTES = 4_096

# Where sitemaps usually live.
COMMON_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml"]

# Text an XML reader with value parsing turns into a number or boolean, i.e. not a string.
_NOT_TEXT = r"^(?:true|false|[-+]?(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?))$"
# The inside of a node that has one plain location, and no more than one plain date beside it.
_PLAIN_NODE = r"^\s*<loc>(https?://[!-;=-~]*)</loc>\s*(?:<lastmod>([0-9]{4}-[!-;=-~]*)</lastmod>\s*)?\z"
_NAME_END = r"(?=[\s>/])"


class ParsedSitemaps(NamedTuple):
    entries: DataFrame
    children: DataFrame
    doc_status: DataFrame


def _without_prolog(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "")


def _text_of(raw: Column) -> Column:
    return trim_ws(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def _children(node: Column) -> Column:
    """array<struct<n, a, t>>: name, attributes and raw inner text of every direct child."""
    pattern = F.lit(r"(?s)<([A-Za-z_][^\s/>]*)(\s[^>]*)?(?<!/)>(.*?)</\1\s*>")
    parts = [F.regexp_extract_all(node, pattern, F.lit(i)) for i in (1, 2, 3)]
    return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "nat", strict=True)])


def _child_texts(children: Column, tag: str) -> Column:
    """Raw inner text of every direct child ``tag``; a child with attributes shows up as null."""
    return F.transform(
        F.filter(children, lambda c: c["n"] == tag), lambda c: F.when(F.length(trim_ws(c["a"])) == 0, c["t"]))


def _string_value(texts: Column) -> Column:
    """The one plain-text child, or null when repeated, structured, blank or not a string."""

    def value(found: Column) -> Column:
        raw = F.get(found, F.lit(0))
        markup = F.regexp_replace(raw, r"(?s)<!\[CDATA\[.*?\]\]>", "").contains("<")
        text = let(_text_of(raw), lambda text: F.when(~text.rlike(_NOT_TEXT), blank_to_null(text)))
        return F.when((F.size(found) == 1) & ~markup, text)

    return let(texts, value)


def sitemap_nodes(xml: Column, tag: str, decode: bool = False) -> Column:
    """array<struct<loc, lastmod>> of the usable ``tag`` nodes, in document order.

    Plain nodes are read by one pattern. The children of any other are found once: inside a lambda Spark evaluates an expression
    anew wherever it stands.
    """

    def pair(loc: Column, lastmod: Column) -> Column:
        loc, lastmod = (decode_text_entities(v) if decode else v for v in (loc, lastmod))
        return F.struct(loc.alias("loc"), lastmod.alias("lastmod"))

    def read(node: Column) -> Column:
        plain = [F.regexp_extract(node, _PLAIN_NODE, i) for i in (1, 2)]
        whole = let(_children(node), lambda children: pair(*[_string_value(_child_texts(children, n)) for n in ("loc", "lastmod")]))
        return F.when(node.rlike(_PLAIN_NODE), pair(plain[0], blank_to_null(plain[1]))).otherwise(whole)

    inner = F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{tag}\s*>"), F.lit(1))
    return F.filter(F.transform(inner, read), lambda node: node["loc"].isNotNull())


def parse_documents(docs: DataFrame, body: str = "body", decode_entities: bool = False) -> DataFrame:
    """Append ``doc_type`` (urlset / sitemapindex / null), ``nodes`` and ``parse_error``.

    A root without attributes and without child elements is only text, hence not a document.
    ``decode_entities`` is off by default, so ``&amp;`` in a location stays as written.
    """
    staged = docs.withColumn("_xml", _without_prolog(F.coalesce(F.col(body), F.lit(""))))
    root = F.regexp_extract("_xml", rf"<(urlset|sitemapindex){_NAME_END}", 1)
    first = F.regexp_extract("_xml", r"<([A-Za-z_][^\s/>]*)", 1)
    structured = F.col("_xml").rlike(
        r"(?s)^[^<]*<[A-Za-z_][^\s/>]*(?:\s+[^\s=>/]+\s*="
        r"|[^>]*(?<!/)>[^<]*+(?:<!\[CDATA\[.*?\]\]>[^<]*+)*<[A-Za-z_])")
    staged = staged.withColumn("doc_type", F.when((root == first) & (F.length(root) > 0) & structured, root))
    none = F.array().cast("array<struct<loc:string,lastmod:string>>")
    return staged.withColumns(
        {
            "nodes": F.when(F.col("doc_type") == "urlset", sitemap_nodes(F.col("_xml"), "url", decode_entities))
            .when(F.col("doc_type") == "sitemapindex", sitemap_nodes(F.col("_xml"), "sitemap", decode_entities))
            .otherwise(none),
            "parse_error": F.when(F.col("doc_type").isNull(), F.lit(UNSUPPORTED_XML)),
        }
    ).drop("_xml")


def exploded_nodes(parsed: DataFrame, doc_type: str, keys: list[str]) -> DataFrame:
    nodes = parsed.filter(F.col("doc_type") == doc_type).select(*keys, F.posexplode("nodes").alias("position", "node"))
    return nodes.select(*keys, F.col("position"), F.col("node.loc").alias("loc"), F.col("node.lastmod").alias("lastmod"))


def parse_sitemaps(
    docs: DataFrame, keys: list[str] | None = None, body: str = "body", decode_entities: bool = False
) -> ParsedSitemaps:
    """Documents to URL entries, child sitemaps (both with loc, lastmod, position) and status."""
    keys = keys or [c for c in docs.columns if c != body]
    parsed = parse_documents(docs.select(*keys, body), body, decode_entities)
    status = parsed.select(
        *keys,
        "doc_type",
        F.size("nodes").alias("node_count"),
        "parse_error",
    )
    return ParsedSitemaps(exploded_nodes(parsed, "urlset", keys), exploded_nodes(parsed, "sitemapindex", keys), status)


def parse_robots(robots: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(competitor_id, domain, url, normalized_url, source_type, line) of usable Sitemap declarations.

    Input: competitor_id, domain, status, body, content_length, error. Failed files, and with ``max_bytes`` larger ones,
    give nothing; malformed or off-domain declarations are ignored.
    """
    usable = robots.filter(
        F.col("status").between(200, 299) & F.col("error").isNull()
        & ~too_large("body", "content_length", max_bytes)
    )
    lines = usable.select("competitor_id", "domain", F.posexplode(F.split("body", "\r?\n", -1)).alias("line", "text"))
    declared = rf"(?i)^[{WHITESPACE}]*Sitemap[{WHITESPACE}]*:[{WHITESPACE}]*([^{WHITESPACE}]+)[{WHITESPACE}]*$"
    return (
        lines.filter(F.col("text").rlike(declared))
        .withColumn("url", F.regexp_extract("text", declared, 1))
        .withColumn("_seen", inspect_url("url", "domain"))
        .filter(F.col("_seen.reason").isNull() & F.col("_seen.normalized_url").isNotNull())
        .select(
            "competitor_id",
            "domain",
            "url",
            F.col("_seen.normalized_url").alias("normalized_url"),
            F.lit("robots").alias("source_type"),
            "line",
        )
    )


def probe_common_paths(domains: DataFrame, landed: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Common sitemap locations of each domain whose landed response looks like a sitemap.

    With ``max_bytes`` a longer body counts as a failed probe.
    """
    candidates = domains.select(
        "competitor_id",
        "domain",
        F.posexplode(F.array(*[F.lit(p) for p in COMMON_PATHS])).alias("line", "path"),
    ).withColumn("url", F.concat(F.lit("https://"), F.col("domain"), F.col("path")))
    candidates = candidates.withColumn("_seen", inspect_url("url", "domain")).filter(F.col("_seen.reason").isNull())
    hits = landed.filter(
        F.col("status").between(200, 299)
        & F.col("error").isNull()
        & ~too_large("body", "content_length", max_bytes)
        & F.col("body").rlike("(?i)<(?:urlset|sitemapindex)(?![A-Za-z0-9_])")
    ).select("competitor_id", canonical_url("url").alias("_key")).distinct()
    return (
        candidates.withColumn("_key", canonical_url("url"))
        .join(hits, ["competitor_id", "_key"], "left_semi")
        .select(
            "competitor_id",
            "domain",
            "url",
            F.col("_seen.normalized_url").alias("normalized_url"),
            F.lit("common_path").alias("source_type"),
            "line",
        )
    )


def root_candidates(robots: DataFrame, common: DataFrame) -> DataFrame:
    """One root per normalized URL: robots before common paths, the last robots spelling wins.

    ``root_order`` is where the URL first turned up (robots lines, then probed paths).
    """
    by_url = ["competitor_id", "normalized_url"]
    is_robots = F.col("source_type") == "robots"
    both = robots.unionByName(common).withColumn(
        "_rank",
        F.struct(is_robots.cast("int").alias("robots"),
                 F.when(is_robots, F.col("line")).otherwise(-F.col("line")).alias("line")),
    )
    picked = both.groupBy(*by_url).agg(
        F.max(F.struct("_rank", "url", "source_type")).alias("best"),
        F.min(F.struct((~is_robots).cast("int").alias("late"), F.col("line").alias("line"))).alias("root_order"),
    )
    return picked.select(
        *by_url,
        F.col("best.url").alias("url"),
        F.col("best.source_type").alias("source_type"),
        (F.col("root_order.late") * 1_000_000_000 + F.col("root_order.line")).cast("bigint").alias("root_order"),
    )
