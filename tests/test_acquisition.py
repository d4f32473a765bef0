from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import acquisition as A


def test_decisions(spark):
    rows = [("cache", 0.1, False, 0.0), ("http", 0.1, True, 0.0), ("http", 0.1, False, 0.0), ("api", 0.1, False, 0.7), ("browser", 0.1, False, 0.0), ("semantic", 0.1, False, 0.0), ("visual", 0.1, False, 0.0), ("http", 0.9, True, 0.0)]
    df = spark.createDataFrame(rows, "s string, q double, api boolean, v double")
    assert [r.x for r in df.select(A.next_strategy(F.col("s"), F.col("q"), F.col("api"), F.col("v")).alias("x")).collect()] == ["http", "api", "browser", "visual", "semantic", "visual", "visual", "http"]
    modes = spark.createDataFrame([("fast", 1.0, 1.0, True, True), ("research", None, None, False, False), ("adaptive", 0.7, None, False, False), ("adaptive", None, 0.5, False, False), ("adaptive", None, None, False, False)], "m string, j double, b double, s boolean, f boolean")
    assert [r.x for r in modes.select(A.needs_browser(F.col("m"), F.col("j"), F.col("b"), F.col("s"), F.col("f")).alias("x")).collect()] == [False, True, True, True, False]
    assert [r.x for r in spark.range(3).select(A.backoff(F.col("id") * 4, F.lit(1.5)).alias("x")).collect()] == [1.5, 24.0, 90.0]


def test_best_capture(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, "u", "http", "text", t), (2, "u", "browser", " ", t), (3, "u", "browser", "more", t), (4, "u", "browser", "newest", t + dt.timedelta(1)), (5, "v", "odd", None, None), (6, None, "api", "x", t)]
    df = spark.createDataFrame(rows, "artifact_id bigint, canonical_url string, strategy_used string, text_content string, captured_at timestamp")
    assert {r.canonical_url: r.artifact_id for r in A.best_capture(df).collect()} == {"u": 4, "v": 5}


def test_caps_and_keys(spark):
    df = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 10), ("q", 11)], "page string, n int")
    assert [r.n for r in A.capped(df, "page", [F.col("n")], 3, 4).orderBy("place").collect()] == [0, 1, 2, 10]
    key = spark.range(1).select(A.idempotency_key(F.lit("e"), F.lit("n"), F.lit(2), F.struct(F.lit(1).alias("a"))).alias("k")).first().k
    assert key.startswith("e:n:r2:") and len(key) == 7 + 16
    assert {r.state: r.n for r in A.state_counts(spark.createDataFrame([("A",), ("A",), (None,)], "state string")).collect()} == {"A": 2, None: 1}


def test_links_and_files(spark):
    df = spark.createDataFrame([("<LINK href='https://a/b' rel=\"canonical\">",), ("<link rel=stylesheet href=x>",), (None,)], "h string")
    assert [r.x for r in df.select(A.canonical_link(F.col("h")).alias("x")).collect()] == ["https://a/b", None, None]
    files = spark.createDataFrame([(bytearray(b"\n%PDF-1.4"),), (bytearray(b" " * 1100 + b"%PDF-1"),), (None,)], "c binary")
    assert [r.x for r in files.select(A.is_pdf(F.col("c")).alias("x")).collect()] == [True, False, False]


def test_locate(spark):
    pages = [(1, bytearray(b"<div id='main' class='a b'>Text</div>")), (2, bytearray(b"<section>Price list <p data-x='1' class='c'>Price: 5</p></section><p>Price</p>")), (3, None)]
    df = spark.createDataFrame(pages, "artifact_id bigint, raw_content binary")
    got = {r.artifact_id: (r.tag, r.text, r.score) for r in A.locate(df, "div#main.b", "p", {"data-x": "", "class": ""}, "Price", "list").collect()}
    assert got == {1: ("div", "Text", 1.0), 2: ("p", "Price: 5", 1.0)}
