"""Queries that give all of a result, against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import acquisition, graphs, metrics, retrieval
from tessera.plans import catalog, ranking_queries, text_queries
from tessera.plans import sql as S


def test_graph_search_reads_bodies_and_substrings(spark):
    docs = [(1, "https://a.example/x", "Title", "Title\n\nA body about magnetism and other things.\n\n# Heading on electromagnetic waves here"), (2, None, "Other", "Nothing of it in these lines")]
    nodes = graphs.compile_graph(spark.createDataFrame(docs, "doc_id int, url string, title string, markdown string"))[0]
    found = graphs.search_graph(nodes, spark.createDataFrame([(0, "Magnet magnet waves"), (1, "")], "query_id int, query string")).collect()
    assert sorted((r.query_id, r.node_id.split("_")[0], r.matched) for r in found) == [(0, "claim:1:h", 2), (0, "evidence:1:p", 1)]


def test_kg_search_equals_brute_force(spark, tiny):
    nodes = text_queries._graph(spark, tiny)[0].collect()
    want = sorted((i, n.node_id, m) for i, q in enumerate(S.QUERIES) for n in nodes if (m := sum(w in n.text.lower() for w in set(q.lower().split()))))
    got = sorted((r.query_id, r.node_id, r.matched) for r in catalog.QUERIES["kg_search"](spark, tiny).collect())
    assert got == want and {n.split(":")[0] for _, n, _ in got} > {"doc"}


def _cosine(a: str, b: str) -> float:
    x, y = (Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % retrieval.DIMENSIONS for w in t.lower().split()) for t in (a, b))
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def test_pool_scores_hold_the_similarity_of_each_candidate(spark, tiny):
    rows = ranking_queries._scored(spark, tiny).collect()
    assert rows and all(abs(r.semantic - _cosine(r.query, f"{r.title}. {r.snippet}")) <= 0.000051 for r in rows)
    assert len({r.semantic for r in rows}) > 1


def test_similarity_of_blank_and_unlike_candidates(spark):
    rows = [("a", "Alpha beta", "alpha", "beta gamma"), ("b", "Alpha beta", "", ""), ("c", "Alpha beta", None, "nothing of it"), ("d", "alpha beta", "x", "alpha beta")]
    got = retrieval.semantic_score(spark.createDataFrame(rows, "canonical string, query string, title string, snippet string"))
    want = {k: _cosine(q, f"{t or ''}. {s or ''}") for k, q, t, s in rows}
    assert {r.canonical: r.semantic for r in got.collect()} == {k: round(v, 4) for k, v in want.items()} and want["d"] > want["a"] > want["b"] == 0


def test_edited_copies_on_other_hosts_are_syndicated(spark, tmp_path):
    text = " ".join(f"word{i} of line{i % 7}" for i in range(400))
    other, third = (" ".join(f"{w}{i}" for i in range(300)) for w in ("other", "third"))
    docs = [(0, "https://a.example/1", text), (1, "https://b.example/1", text + " edited"), (2, "https://c.example/1", other), (3, "https://d.example/1", third), (4, "https://e.example/1", None), (5, "https://a.example/2", text + " again")]
    spark.createDataFrame(docs, "doc_id bigint, url string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source_id: r.relation for r in catalog.QUERIES["lineage_copies"](spark, str(tmp_path)).collect()}
    alone = "INDEPENDENT_CORROBORATION"
    assert got == {0: "PRIMARY_SOURCE", 1: "SYNDICATED_COPY", 2: alone, 3: alone, 4: alone, 5: "SAME_PUBLISHER"}
    assert catalog.QUERIES["independent_sources_copies"](spark, str(tmp_path)).first().independent_sources == 4


def test_hashes_ignore_compatibility_forms(spark, tiny):
    import re
    import unicodedata

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    docs_ = spark.createDataFrame([(1, "Ａｂｃ ﬁne"), (2, "abc fine"), (3, None), (4, "")], "doc_id bigint, text string")

    def want(text):
        plain = re.sub("\n+", "\n", re.sub("[ \t]+", " ", unicodedata.normalize("NFKC", text or "")))
        return hashlib.sha256(re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", plain).lower().encode()).hexdigest()

    got = {r.doc_id: r.content_hash for r in catalog.QUERIES["normalised_hashes"](spark, tiny).collect()}
    assert got == {k: want(t) for k, t in docs.items()}
    hashes = {r.doc_id: r.h for r in docs_.select("doc_id", T.content_hash(T.compatible(F.col("text"))).alias("h")).collect()}
    assert hashes[1] == hashes[2] and hashes[3] == hashes[4]


def test_links_to_follow(spark):
    rows = [
        ("p", "https://a.x/1", 0.5, False, False), ("p", "https://a.x/1#top", 0.9, False, False), ("p", "https://a.x/2", 0.9, False, False), ("p", "https://a.x/3", 0.95, True, False), ("p", "https://a.x/4", 0.95, False, True),
        ("p", "https://a.x/file.pdf", 0.99, False, False), ("p", "https://a.x/login", 0.99, False, False), ("p", "https://a.x/", 0.99, False, False), ("p", "https://a.x/5", 0.1, False, False), ("q", "https://a.x/1", 0.1, False, False), ("q", None, 1.0, False, False),
    ]
    got = acquisition.expansion_links(spark.createDataFrame(rows, "page string, url string, score double, is_navigation boolean, is_footer boolean"), 2)
    assert sorted((r.page, r.place, r.canonical) for r in got.collect()) == [("p", 0, "https://a.x/2"), ("p", 1, "https://a.x/1"), ("q", 0, "https://a.x/1")]


def test_a_missing_capability_is_an_error():
    assert metrics.require({"search": "enabled"}, "search") == "enabled"
    for name in ("ocr", "unknown"):
        with pytest.raises(metrics.CapabilityUnavailable):
            metrics.require({"ocr": "disabled"}, name)


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot", i, i % 7 if i % 5 else None) for i in range(3000)] + [("cold", 1, 5), (None, 1, 2)]
    got = {(r.job, r.seq): (r.n, r.total, r.mean) for r in metrics.running_totals(spark.createDataFrame(rows, "job string, seq int, bytes int")).collect()}
    total = known = 0
    for n, (job, seq, b) in enumerate(rows[:3000], 1):
        total, known = total + (b or 0), known + (b is not None)
        assert got[job, seq][:2] == (n, total if known else None) and (not known or abs(got[job, seq][2] - total / known) < 1e-6)
    assert got["cold", 1] == (1, 5, 5.0) and got[None, 1] == (1, 2, 2.0)
    assert metrics.running_totals(spark.createDataFrame([], "job string, seq int, bytes int")).count() == 0


def test_search_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Alpha", "x-1", "été", "."]
    texts = [(f"p{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [("n", None), ("e", ""), ("t", "Alpha x-1"), ("u", "Alpha x-1")]
    asked = [(0, "alpha x-1 été"), (1, "w1 w2 w2"), (2, ""), (3, None)]
    df, queries = spark.createDataFrame(texts, "id string, text string").repartition(5), spark.createDataFrame(asked, "query_id int, query string")

    def dense(text):
        n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % retrieval.DIMENSIONS for w in (text or "").lower().split())
        size = math.sqrt(sum(v * v for v in n.values())) or 1
        return {k: v / size for k, v in n.items()}

    def sparse(text):
        out = {}
        for w, n in Counter(t for t in re.findall(r"[a-zA-Z0-9_.-]+", (text or "").lower()) if len(t) > 1).items():
            k = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % retrieval.SPARSE
            out[k] = max(out.get(k, 0), round((1 + (n - 1) * 0.2) * (1.5 if re.search("[-_.0-9]", w) else 1), 3))
        return out

    want = set()
    for branch, make in (("dense", dense), ("sparse", sparse)):
        for q, query in asked:
            a = make(query)
            rows = [(-round(sum(v * a[k] for k, v in make(t).items() if k in a), 4), i) for i, t in texts if set(make(t)) & set(a)]
            want |= {(q, i, branch, -s) for s, i in sorted(rows)[:7]}
    got = retrieval.branch_scores(df, queries, 7).collect()
    assert {(r.query_id, r.id, r.branch, round(r.score, 4)) for r in got} == want and len(got) == len(want)
    assert retrieval.branch_scores(df.where("false"), queries).count() == 0 and retrieval.branch_scores(df, queries.where("false")).count() == 0
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    with pytest.raises(ValueError):
        retrieval.branch_scores(df, queries)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(90, None), (91, [0.0] * 4), (92, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 9 = 0 and vec_id < 90").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = {tuple(r) for r in retrieval.nearest(df, asked, 5).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in retrieval.nearest(df, asked, 5).collect()} == whole and len(whole) == 50
    assert all((q, q) in {(r[0], r[1]) for r in whole} for q in range(0, 90, 9))
    assert retrieval.nearest(df, asked.where("false")).count() == 0
