import re

import pytest
from pyspark.sql import functions as F

from sitetide.functions import html as H

PAGE = """
<html><head><title> </title><title>A &amp;amp; B&nbsp;&#x41;&#66;&hellip;</title>
<META Name='Description' content="one &lt;two&gt;"><meta name=description content="later">
<meta name="robots" content="  "><link rel="alternate CANONICAL" href="../c?x=1">
</head><body xml:lang="zz"><nav><a href="/boats">All boats</a></nav><STYLE>p { color: teal }</style><header>Harbour <i>club</i></header>
<main><h1><b>Big</b> ﻿one</h1><h2>First</h2><h2></h2><h2 class="x">Second<br>line</h2> Tides of the week</main>
<script>let berth = 7</script><footer>Opens at noon</footer></body></html>
"""


def one(spark, expr, html=PAGE):
    return spark.createDataFrame([(html,)], "html string").select(expr.alias("r")).first()["r"]


def test_fields(spark):
    df = spark.createDataFrame([(PAGE.replace("<html>", '<html data-x=1 lang=" en " >'), "https://example.com/a/b/")],
                               "html string, url string")
    row = H.extract_seo(df).first()
    assert row["title"] == "A &amp; B AB&hellip;"
    assert row["meta_description"] == "one <two>"
    assert row["robots_meta"] is None
    assert row["canonical_url"] == "https://example.com/a/c?x=1"
    assert row["h1"] == "Big one"
    assert row["h2"] == ["First", "Second line"]
    assert row["page_language"] == "en"
    assert row["seo_error"] is None
    text = row["content_excerpt"]
    assert text.endswith("Tides of the week")
    assert not [word for word in ("teal", "berth", "boats", "Harbour", "noon") if word in text]


def test_functions_agree_with_extract(spark):
    df = spark.createDataFrame([(PAGE, "https://example.com/a/b/")], "html string, url string")
    row = H.extract_seo(df).select(
        "*",
        H.first_tag_text("html", "title").alias("t"), H.all_tag_text("html", "h2", 30).alias("hh"),
        H.meta_content("html", "description").alias("d"), H.link_href("html", "canonical").alias("l"),
        H.content_excerpt("html").alias("e"),
    ).first()
    assert (row["t"], row["hh"], row["d"], row["l"], row["e"]) == (
        row["title"], row["h2"], row["meta_description"], "../c?x=1", row["content_excerpt"])


@pytest.mark.parametrize("text,expected", [
    ("&amp;lt;", "&lt;"), ("&#38;amp;", "&amp;"), ("a&b;c", "a&b;c"), ("&&lt;;", "&<;"), ("&NBSP;x", " x"),
    ("&#128512;", "\U0001F600"), ("&#12ab;", "\x0c"), ("&#x1F600;", "\U0001F600"),
    ("&#XA0;", None), ("&#ab;", None), ("&#1114112;", None), ("&#1114111;", "\U0010FFFF"), ("&#x110000;", None),
    ("&#x10FFFF;", "\U0010FFFF"), ("&#00000000065;", "A"), ("&#;", "&#;"), ("plain", "plain"),
])
def test_decode_entities(spark, text, expected):
    assert one(spark, H.decode_entities("html"), text) == expected


def test_excerpt_limits(spark):
    html = "<html><body>" + "a" * 8200 + "</body></html>"
    assert len(one(spark, H.content_excerpt("html"), html)) == 8200
    assert len(one(spark, H.content_excerpt("html", 8000), html)) == 8000
    assert len(one(spark, H.content_excerpt("html", 100), html)) == 100
    assert one(spark, H.content_excerpt("html"), "<p> </p>") is None


def test_errors_fail_the_page(spark):
    df = spark.createDataFrame(
        [("<title>&#ab;</title>", "https://e.com/"), ('<link rel=canonical href="http://a b/">', "https://e.com/"),
         ('<script>&#ab;</script>', "https://e.com/"), (None, "https://e.com/")], "html string, url string")
    assert [r["seo_error"] for r in H.extract_seo(df).collect()] == [H.ERROR_ENTITY, H.ERROR_URL, None, None]


def test_attribute_quirks(spark):
    assert one(spark, H.attribute("html", "name"), '<meta data-name="a" name="b">') == "a"
    assert one(spark, H.attribute("html", "content"), "<meta content=\"it's\">") == "it"
    assert one(spark, H.attribute("html", "content"), "<meta content = plain/>") == "plain/"


def restate(html):
    ws = "\t\n\x0B\x0c\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
    text = re.sub(r"(?is)<(script|style|noscript|svg|template)\b.*?</\1>", " ", html)
    text = re.sub(r"(?is)<(nav|footer|header)\b.*?</\1>", " ", text)
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"&([a-z]+);", lambda m: H.NAMED_ENTITIES.get(m[1].lower(), m[0]), text, flags=re.I)
    return re.sub(f"[{ws}]+", " ", text).strip(ws.replace("-", "")) or None


def test_visible_text_on_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in pages.select("html", H.visible_text("html").alias("t")).collect():
        assert row["t"] == restate(row["html"])
