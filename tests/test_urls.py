import random

import pytest
from pyspark.sql import functions as F

from sitetide.functions import urls as U

# The first three pairs are fixed values: they define the normal form.
NORMALIZED = [
    ("HTTPS://Example.COM:443/products/item/?utm_source=x&b=2&a=1#details", "https://example.com/products/item?a=1&b=2"),
    ("https://example.com/search?size=large&q=mixer&size=small", "https://example.com/search?q=mixer&size=large&size=small"),
    ("https://example.com", "https://example.com/"),
    ("http://example.com:80//a///b//", "http://example.com/a/b"),
    ("http://example.com:8080/a/?", "http://example.com:8080/a"),
    ("  https://example.com/a b\n ", "https://example.com/a%20b"),
    ("https:\\\\example.com\\a\\..\\b", "https://example.com/b"),
    ("https:example.com/x/./y/%2E%2e/z", "https://example.com/x/z"),
    ("https://example.com/é?q=é+x&k", "https://example.com/%C3%A9?k=&q=%C3%A9+x"),
    ("https://example.com/?UTM_Source=1&GCLID=2&fbclid=3&msclkid=4", "https://example.com/"),
    ("https://user:pw@www.example.com/a", "https://user:pw@www.example.com/a"),
    ("https://example.com/?B=1&a=2&b=3", "https://example.com/?a=2&b=3&B=1"),
    ("https://example.com/?a=1&&b=%zz&c=~*", "https://example.com/?a=1&b=%25zz&c=%7E*"),
    ("https://example.com/%2f%41", "https://example.com/%2f%41"),
    ("https://bücher.example/", "https://xn--bcher-kva.example/"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://0300.168.0.1/", "http://192.168.0.1/"),
    ("http://[2001:DB8:0:0:1:0:0:1]/a", "http://[2001:db8::1:0:0:1]/a"),
    ("http://[::1]:80/", "http://[::1]/"),
    ("http://256.1.1.1/", None),
    ("http://exa mple.com/", None),
    ("http://example.com:99999/", None),
    ("http://example.com:8x/", None),
    ("ftp://example.com/a", None),
    ("not-a-url", None),
    ("https://", None),
    ("/relative", None),
    (None, None),
]


def run(spark, values, fn, *extra):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 1
    schema = "i int, " + ", ".join(f"c{k} string" for k in range(width))
    df = spark.createDataFrame(rows, schema)
    out = df.select("i", fn(*[F.col(f"c{k}") for k in range(width)], *extra).alias("r")).orderBy("i").collect()
    return [row["r"] for row in out]


def test_normalize_url(spark):
    got = run(spark, [a for a, _ in NORMALIZED], U.normalize_url)
    assert dict(zip([a for a, _ in NORMALIZED], got)) == dict(NORMALIZED)


def test_normalize_is_idempotent(spark):
    once = [b for _, b in NORMALIZED if b]
    assert run(spark, once, U.normalize_url) == once


def test_normalize_domain(spark):
    values = ["WWW.Example.com", "HTTPS://EXAMPLE.COM/", "ftp://example.com", "www.www.example.com", "a b"]
    assert run(spark, values, U.normalize_domain) == ["example.com", "example.com", None, "www.example.com", None]


GUARD = [
    ("https://www.example.com/page", "example.com", None),
    ("https://shop.example.com/page", "www.example.com", None),
    ("http://localhost/admin", "example.com", U.REASON_LOCALHOST),
    ("http://a.localhost/admin", "example.com", U.REASON_LOCALHOST),
    ("http://169.254.169.254/latest", "example.com", U.REASON_PRIVATE_IP),
    ("http://0xA9FEA9FE/latest", "example.com", U.REASON_PRIVATE_IP),
    ("http://172.31.0.1/", "example.com", U.REASON_PRIVATE_IP),
    ("http://172.32.0.1/", "172.32.0.1", None),
    ("http://[fe80::1]/", "example.com", U.REASON_PRIVATE_IP),
    ("http://[::]/", "example.com", U.REASON_PRIVATE_IP),
    ("https://u@example.com/", "example.com", U.REASON_CREDENTIALS),
    ("mailto:a@example.com", "example.com", U.REASON_SCHEME),
    ("nope", "example.com", U.REASON_INVALID),
    ("https://attacker.example/", "example.com", "Outbound host attacker.example is outside competitor domain example.com"),
    ("https://notexample.com/", "example.com", "Outbound host notexample.com is outside competitor domain example.com"),
]


def test_outbound_guard(spark):
    got = run(spark, [(u, d) for u, d, _ in GUARD], U.outbound_guard)
    assert [(g["ok"], g["reason"]) for g in got] == [(r is None, r) for _, _, r in GUARD]


INTERNATIONAL = [
    ("https://stra\u00dfe.de/a", "https://xn--strae-oqa.de/a"), ("https://STRA\u00dfE.Example.de", "https://xn--strae-oqa.example.de/"),
    ("https://\u03b2\u03cc\u03bb\u03bf\u03c2.com", "https://xn--nxasmm1c.com/"), ("https://\u0392\u038c\u039b\u039f\u03a3.com", "https://xn--nxasmq6b.com/"),
    ("https://fa\u00df\u3002example.com", "https://xn--fa-hia.example.com/"), ("https://a\u200cb.com", None),
    ("https://\u0dc1\u0dca\u200d\u0dbb\u0dd3.com", "https://xn--10cl1a0b660p.com/"), ("https://xn--strae-oqa.de", "https://xn--strae-oqa.de/"),
]


def test_international_hosts(spark):
    assert run(spark, [u for u, _ in INTERNATIONAL], U.normalize_url) == [n for _, n in INTERNATIONAL]


def test_labels_are_encoded_like_the_codec(spark):
    rng = random.Random(8)
    letters = "abz09-\u00df\u03c2\u00fc\u00e9\u4e2d\u6587\u0431\U00020000"
    labels = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    labels = [x for x in labels if ("\u00df" in x or "\u03c2" in x) and not x.isascii()]
    got = run(spark, [f"https://{x}.com/" for x in labels], U.normalize_url)
    assert got == [f"https://xn--{x.encode('punycode').decode()}.com/" for x in labels]


RESOLVED = [
    ("/new.xml", "https://example.com/a/old.xml?x=1", "https://example.com/new.xml"),
    ("new.xml", "https://example.com/a/old.xml", "https://example.com/a/new.xml"),
    ("../new.xml?q=a b#f", "https://example.com/a/b/old.xml", "https://example.com/a/new.xml?q=a%20b#f"),
    ("//cdn.example.com/x", "http://example.com/", "http://cdn.example.com/x"),
    ("https://Other.example/X", "https://example.com/", "https://other.example/X"),
    ("?p=2", "https://example.com/a?p=1#z", "https://example.com/a?p=2"),
    ("#frag", "https://example.com/a?p=1#z", "https://example.com/a?p=1#frag"),
    ("", "https://example.com/a?p=1#z", "https://example.com/a?p=1"),
    ("https:rel", "https://example.com/a/b", "https://example.com/a/rel"),
    ("mailto:x@y", "https://example.com/", "mailto:x@y"),
    ("http://a b/", "https://example.com/", None),
    ("x", "nope", None),
]


def test_resolve_url(spark):
    got = run(spark, [(h, b) for h, b, _ in RESOLVED], U.resolve_url)
    assert got == [r for _, _, r in RESOLVED]


@pytest.mark.parametrize("host,blocked", [
    ("300.1.1.1", True), ("10.0.0.1", True), ("8.8.8.8", False), ("224.0.0.1", True),
    ("192.168.1.1", True), ("[fd00::1]", True), ("[2001:db8::1]", False), ("example.com", False), ("fc.example.com", False),
])
def test_blocked_ip(spark, host, blocked):
    assert run(spark, [host], U.is_blocked_ip) == [blocked]
