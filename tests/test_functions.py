from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "declared", "want"),
    [
        ("HTTP://Example.COM:80/docs/index.html?utm_source=google&b=2&a=1#section1", None, "http://example.com/docs/index.html?a=1&b=2"),
        ("https://site.com/product?fbclid=12345&gclid=67890&id=99", None, "https://site.com/product?id=99"),
        ("https://site.com/page?variant=2", "https://site.com/page", "https://site.com/page"),
        ("http://arxiv.org/abs/2309.15217v2", None, "https://arxiv.org/abs/2309.15217v2"),
        ("https://example.com/a%2Fb", None, "https://example.com/a%2Fb"),
        ("http://example.com:8080/path", None, "http://example.com:8080/path"),
        ("https://example.com:443/path", None, "https://example.com/path"),
        ("https://example.com", None, "https://example.com/"),
        ("https://example.com//a///b/", None, "https://example.com/a/b/"),
        ("https://example.com/a%20b+c?q=x+y&z=", None, "https://example.com/a b+c?q=x+y&z="),
        ("https://example.com/%zz", None, "https://example.com/%25zz"),
        (None, None, None),
    ],
)
def test_canonical_url(spark, url, declared, want):
    df = spark.createDataFrame([(url, declared)], "u string, d string")
    assert df.select(U.canonical_url(F.col("u"), F.col("d")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("ftp://a.b/c", "UNSUPPORTED_SCHEME"), (None, "UNSUPPORTED_SCHEME"), ("https://a.b/login/x", "AUTHENTICATION_URL"), ("https://a.b/x.pdf", "BINARY_DOCUMENT_URL"),
        ("https://a.b/x?f=y.docx", "BINARY_DOCUMENT_URL"), ("https://a.b/search", "SEARCH_LISTING_URL"), ("https://a.b/x?page=2", "SEARCH_LISTING_URL"), ("https://a.b/x?page=", None),
        ("https://a.b/", "DOMAIN_HOME_URL"), ("https://a.b/paper", None),
    ],
)
def test_rejection_reason(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(U.rejection_reason(F.col("u")).alias("x")).first().x == want


@pytest.mark.parametrize(("address", "want"), [("10.1.2.3", True), ("172.15.0.1", False), ("172.31.0.1", True), ("8.8.8.8", False), ("300.1.1.1", None), ("x", None), (None, None)])
def test_blocked_addresses(spark, address, want):
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(U.is_blocked_ipv4(F.col("a")).alias("x")).first().x == want


def test_host_and_redirect(spark):
    assert one(spark, U.host(F.col("u")), u="https://www.A-b.example:8080/x") == "a-b.example"
    assert one(spark, U.host(F.col("u")), u="no address") is None
    assert one(spark, U.unwrapped(F.col("u")), u="//d.example/l/?uddg=https%3A%2F%2Fx.y%2Fz&r=1") == "https://x.y/z"
    assert one(spark, U.doi(F.col("u")), u="see doi:10.1234/ab.c-1.") == "10.1234/ab.c-1"


@pytest.mark.parametrize(("text", "want"), [("", 0), (None, 0), ("a", 1), ("a b c d", 5), ("x" * 35, 10)])
def test_token_estimate(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.token_estimate(F.col("t")).alias("x")).first().x == want


def test_text_helpers(spark):
    assert one(spark, T.sanitised(F.col("t")), t=" a\x00b\x07\n ") == "ab"
    assert one(spark, T.clean_markdown(F.col("t")), t="  a b  \n\n\n\nc ") == "a b\n\nc"
    assert one(spark, T.slug(F.col("t")), t="  Über: 2 Dinge!") == "über-2-dinge"
    assert one(spark, T.sentences(F.col("t"), 3), t="One two. No. Three four!") == ["One two.", "Three four!"]
    assert one(spark, T.fit_markdown(F.col("t")), t="text\n[x](/a)\nmore") == "text\nmore"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_hamming_is_a_distance(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [tuple(r) for r in df.select(V.hamming(F.col("a"), F.col("b")), V.hamming(F.col("b"), F.col("a")), V.hamming(F.col("a"), F.col("a"))).collect()]
    assert got == [((a ^ b).bit_count(), (a ^ b).bit_count(), 0) for a, b in rows]
