from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, classify, dedup, evidence, graphs, markup, metrics, ranking, retrieval
from tessera.operators.positions import grouped_positions


def test_positions_equal_a_plain_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.position for r in grouped_positions(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[r[2]] = p
    assert got == want
    assert grouped_positions(df.where("false"), ["k"], [F.col("v")]).count() == 0
    assert sorted(r.position for r in grouped_positions(df, [], [F.col("i")]).collect()) == list(range(500))


def _prints():
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    return [(i, base[i % 30] ^ sum({1 << rng.randrange(63) for _ in range(i // 30 * 3)}) ^ ((1 << 63) if i % 2 else 0)) for i in range(150)] + [(500, 0), (501, 0), (502, base[0]), (503, base[0])]


@pytest.mark.parametrize("distance", [0, 3, 6, 12])
def test_near_pairs_equal_brute_force(spark, distance):
    prints = [(i, f - (1 << 64) if f >> 63 else f) for i, f in _prints()]
    df = spark.createDataFrame(prints, "id bigint, fingerprint bigint")
    apart = lambda f, g: ((f ^ g) & (1 << 64) - 1).bit_count()
    want = {(a, b): apart(f, g) for a, f in prints for b, g in prints if a < b and f and g and apart(f, g) <= distance}
    rows = dedup.near_pairs(df, distance).collect()
    assert len(rows) == len(want) and {(r.id_a, r.id_b): r.distance for r in rows} == want
    near = {r.id: (r.n_near, r.near_dup_of) for r in dedup.near_matches(df, distance).collect()}
    assert near == {i: (sum(i in p for p in want), min((a for a, b in want if b == i), default=None)) for i, _ in prints}
    label = {i: i for i, _ in prints}
    for _ in prints:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.cluster for r in dedup.clusters(df, distance).collect()} == label
    with pytest.raises(ValueError):
        dedup.near_pairs(df, 16)


def test_clusters_grow_batch_by_batch(spark):
    prints = [(i, f - (1 << 64) if f >> 63 else f) for i, f in _prints()]
    random.Random(5).shuffle(prints)
    schema = "id bigint, fingerprint bigint"
    known = spark.createDataFrame([], schema + ", cluster bigint")
    for at in range(0, len(prints), 52):
        known = dedup.incremental_clusters(known, spark.createDataFrame(prints[at : at + 52], schema), 6)
    whole = dedup.clusters(spark.createDataFrame(prints, schema), 6)
    assert {r.id: r.cluster for r in known.collect()} == {r.id: r.cluster for r in whole.collect()}


def test_whole_texts_are_folded(spark):
    words = " ".join(f"w{i}" for i in range(12_000))
    df = spark.createDataFrame([(1, words), (2, words + " tail" * 9_000), (3, words), (4, " ")], "doc_id bigint, text string")
    got = {r.id: r.fingerprint for r in dedup.simhash(df).collect()}
    head = {r.id: r.fingerprint for r in dedup.simhash(df, most=10_000).collect()}
    assert got[1] == got[3] != got[2] and head[1] == head[2] and set(got) == {1, 2, 3}


def test_simhash_examples(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, fox), (2, fox + "!"), (3, "Unrelated article about quantum mechanics and particle physics"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r.id: r.near_dup_of for r in dedup.near_matches(dedup.simhash(df)).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(90)] + [(100, 101), (105, 101)], "id_a bigint, id_b bigint")
    got = {r.id: r.cluster for r in dedup.components(df).collect()}
    assert got == {i: 0 for i in range(91)} | {100: 100, 101: 100, 105: 100}


@pytest.mark.parametrize(
    ("url", "text", "title", "want"),
    [
        ("https://a.b/paper", "<h1>Access Denied</h1><p>Reference #123</p>", "", "BLOCK_PAGE"),
        ("https://arxiv.org/search/cs?searchtype=author&query=x", "Substantive evidence. " * 20, "t", "SEARCH_LISTING"),
        ("https://a.b/abs/1", "Substantive evidence. " * 20, "t", "DOCUMENT"),
        ("https://a.b/abs/1", "Substantive evidence. " * 100 + "Log in | Sign in", "t", "DOCUMENT"),
        ("https://a.b/", "short", "", "NAVIGATION"),
        (None, None, None, "NAVIGATION"),
    ],
)
def test_document_type(spark, url, text, title, want):
    df = spark.createDataFrame([(url, text, None, "text/html", title, None)], "url string, text string, status_code int, content_type string, title string, link_density double")
    assert classify.document_type(df).first().doc_type == want


def test_page_boundaries(spark):
    html = lambda scripts, tables: "react-dom" + "<script>" * scripts + "<table>" * tables
    rows = [(200, "text/html", html(15, 2) + " " * 2000, None), (200, "text/html", html(16, 3) + " " * 2000, None), (403, "text/html", "", None), (200, "application/json", "", [("x/json", "u")]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "status_code int, content_type string, html string, requests array<struct<mime:string,url:string>>")
    got = [(r.js_dependency_score, r.visual_score, r.block_score) for r in classify.page_intelligence(df).collect()]
    assert got == [(0.5, 0.1, 0.0), (0.7, 0.4, 0.0), (0.85, 0.1, 0.95), (0.0, 0.0, 0.0), (0.1, 0.1, 0.0)]


def test_merge_keeps_both_origins(spark):
    rows = [(1, "https://example.com/doc?utm_source=test", "Title 1", "s", "arxiv", 3, "X", "2020", 0.4, ["g1"], ["q"]), (2, "https://example.com/doc", "Longer Detailed Title 1", "t", "wikipedia", 1, "Y", None, 0.9, ["g2"], ["q"]), (3, None, "x", "y", "z", 1, "X", None, 0.1, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, url string, title string, snippet string, provider string, provider_rank int, source_type string, published_at string, authority_prior double, goal_ids array<string>, query_variants array<string>")
    (r,) = ranking.merge_candidates(df).collect()
    assert (r.title, r.snippet, r.providers, r.goal_ids, r.query_variants, r.provider_rank, r.authority_prior, r.source_type) == ("Longer Detailed Title 1", "s", ["arxiv", "wikipedia"], ["g1", "g2"], ["q"], 1, 0.9, "X")


def test_authority(spark):
    df = spark.createDataFrame([("arxiv.org", "BLOG"), ("x.nature.com", None), ("nowhere.net", "WIKI"), ("nowhere.net", "FORUM"), (None, "STANDARD")], "domain string, source_type string")
    assert Counter(r.authority for r in ranking.authority_prior(df).collect()) == Counter([0.90, 0.98, 0.75, 0.50, 0.94])


def test_fusion_puts_the_common_hit_first(spark):
    df = spark.createDataFrame([("q", "h1", "dense", 0.9), ("q", "h2", "dense", 0.8), ("q", "h1", "sparse", 0.5)], "query_id string, id string, branch string, score double")
    rows = ranking.fuse(df, {"dense": 0.6, "sparse": 0.4}).orderBy("place").collect()
    assert [(r.id, r.dense_rank, r.sparse_rank) for r in rows] == [("h1", 1, 1), ("h2", 2, None)]
    assert rows[0].fusion_score == round(0.6 / 61 + 0.4 / 61, 6)


def test_rerank_prefers_figures(spark):
    df = spark.createDataFrame([("effect of dose", "t", "The dose had an effect.", None, None), ("effect of dose", "t", "n = 120, 95% CI, p < 0.05, AUROC; dose effect", 0.5, 0.01)], "query string, title string, text string, authority_score double, fusion_score double")
    plain, rich = [r.rerank_score for r in ranking.rerank(df).collect()]
    assert rich > plain


def test_diverse_choice(spark):
    rows = [("q", f"d{i}", "https://one.example/x" if i < 4 else f"https://s{i}.example/x", "same words here" if i < 4 else f"text {i}", 1.0 - i / 100, i) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id string, id string, url string, text string, score double, place int")
    assert [r.id for r in ranking.select_diverse(df, 3).orderBy("place").collect()][0] == "d0"
    assert {r.id for r in ranking.select_diverse(df, 3).collect()} == {"d0", "d4", "d5"}
    assert [r.id for r in ranking.select_diverse(df, 10).orderBy("place").collect()] == [f"d{i}" for i in range(6)]


def test_claims(spark):
    claims = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "claim_id string")
    items = spark.createDataFrame([("a", "1", "SUPPORTS", "europepmc.org"), ("a", "2", "SUPPORTS", "nejm.org"), ("b", "3", "SUPPORTS", "x"), ("b", "3", "SUPPORTS", "x"), ("c", "4", "CONTRADICTS", "x"), (None, "5", "SUPPORTS", "x")], "claim_id string, evidence_id string, relation string, domain string")
    assert {r.claim_id: r.status for r in evidence.claim_status(claims, items).collect()} == {"a": "VERIFIED", "b": "SUPPORTED", "c": "REFUTED", "d": "UNVERIFIED"}


def test_lineage(spark):
    rows = [(1, "s1", "a", "h1", 0), (2, "s2", "b", "h1", 0), (3, "s3", "a", "h1", 0), (4, "s4", "c", None, 7), (5, "s5", "d", "", 7), (6, "s6", None, None, None)]
    df = spark.createDataFrame(rows, "seq int, source_id string, domain string, content_hash string, cluster int")
    got = {r.source_id: r.relation for r in evidence.lineage(df).collect()}
    assert got == {"s1": "PRIMARY_SOURCE", "s2": "DERIVED_MIRROR", "s3": "SAME_PUBLISHER", "s4": "INDEPENDENT_CORROBORATION", "s5": "SYNDICATED_COPY", "s6": "INDEPENDENT_CORROBORATION"}


def test_source_quality(spark):
    schema = "source_id string, url string, title string, source_type string, relevance_score double, text string"
    two = [(f"s{i}", f"https://arxiv.org/abs/{i}", "A survey", "UNKNOWN", 0.9, "w " * 300) for i in range(2)]
    three = [("a", "https://arxiv.org/abs/1", "A survey", "UNKNOWN", 0.9, "w " * 300), ("b", "https://link.springer.com/x", "t", "UNKNOWN", 0.9, "w " * 300), ("c", "https://europepmc.org/article/1", "t", "UNKNOWN", 0.9, "w " * 300)]
    r = evidence.source_quality(spark.createDataFrame(two, schema)).first()
    assert (r.passed, r.direct_count) == (False, 2) and "MIN_INDEPENDENT_DOMAINS" in r.missing
    r = evidence.source_quality(spark.createDataFrame(three, schema)).first()
    assert (r.passed, r.independent_domains) == (True, 3)
    assert evidence.source_quality(spark.createDataFrame([], schema)).first().passed is False


def test_chunks_stay_within_the_target(spark):
    long = " ".join(f"w{i}" for i in range(250)) + "."
    df = spark.createDataFrame([("d", "T", f"# A\n\n{long}\n\n## B\n\nshort text here.\n\n| a | b |\n| 1 | 2 |"), ("e", None, None), ("f", "x", "  ")], "document_id string, title string, markdown string")
    strict = chunking.chunk_documents(df, 100, nested=False, strict=True).collect()
    assert max(r.word_count for r in strict) <= 100 and {r.document_id for r in strict} == {"d"}
    loose = chunking.linked(chunking.chunk_documents(df, 100)).orderBy("ordinal").collect()
    assert loose[0].previous_chunk_id is None and loose[0].next_chunk_id == loose[1].chunk_id
    assert loose[-1].heading_path == ["T", "A", "B"] or loose[-1].heading_path[-1] == "B"


def test_tables_links_markdown(spark):
    html = b"""<html><body><nav><a href='/n'>N</a></nav><h2>Head</h2><p>Text <b>bold</b> <a href="/x?a=1">link</a><a href='mailto:a@b'>m</a></p>
      <table><tr><th>Header 1</th><th>Header 2</th></tr><tr><td rowspan=2>A</td><td>B|</td></tr><tr><td>C</td></tr></table><table></table></body>"""
    df = spark.createDataFrame([(1, "https://s.example/p/", bytearray(html)), (2, None, None)], "artifact_id bigint, url string, raw_content binary")
    full, empty = sorted(markup.tables(df).collect(), key=lambda r: r.table_index)
    assert full.headers == ["Header 1", "Header 2"] and full.rows == [["A", "B|"], ["A", "C"]] and "B\\|" in full.markdown and empty.rows == []
    links = markup.links(df).orderBy("position").collect()
    assert [(r.url, r.anchor, r.is_navigation, r.heading) for r in links] == [("https://s.example/n", "N", True, ""), ("https://s.example/x?a=1", "link", False, "Head")]
    text = {r.artifact_id: r.markdown for r in markup.markdown(df).collect()}
    assert "## Head" in text[1] and "**bold**" in text[1] and "[link](/x?a=1)" in text[1] and text[2] == ""


def test_sitemap(spark):
    df = spark.createDataFrame([("<urlset xmlns='x'><url><loc>https://a.b/c</loc></url><url><loc>ftp://n</loc></url></urlset>",)], "xml string")
    assert [r.url for r in markup.sitemap_urls(df).collect()] == ["https://a.b/c"]


def test_graph(spark):
    df = spark.createDataFrame([("7", "https://a.b/c", "T", "# One big heading here\n\nA paragraph of five words.\n\ntoo short"), ("8", None, None, None)], "doc_id string, url string, title string, markdown string")
    nodes, edges = graphs.compile_graph(df)
    assert Counter(r.kind for r in nodes.collect()) == {"DOCUMENT": 2, "PROPOSITION": 1, "EVIDENCE": 1}
    assert {r.relation for r in edges.collect()} == {"derived_from", "evidence_for"}


def test_expand(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("x", None)], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in graphs.expand(links, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_metrics(spark):
    found = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "query_id string, id string, rank int")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "z", 1)], "query_id string, id string, grade int")
    got = {r.query_id: (r.recall, r.precision, r.mrr) for r in metrics.retrieval_metrics(found, grades, 10).collect()}
    assert got == {"q": (0.5, 0.1, 0.5), "r": (1.0, 0.0, 0.0)}


def test_ewma_equals_the_fold(spark):
    values = [5.0, 1.0, 4.0, 2.0]
    df = spark.createDataFrame([("k", v, i, i) for i, v in enumerate(values)], "k string, value double, ts int, seq int")
    fold = values[0]
    for v in values[1:]:
        fold = 0.8 * fold + 0.2 * v
    assert metrics.ewma(df, ["k"]).first().ewma == round(fold, 6)


def test_admission(spark):
    df = spark.createDataFrame([("j", 1, 60, 0), ("j", 2, 60, 0), ("j", 3, 40, 0), ("j", 4, 1, 9), ("j", 5, 0, 0), ("j", 6, 0, 0)], "job string, seq bigint, bytes bigint, depth int")
    got = [(r.seq, r.reason) for r in metrics.admit(df, pages=3, bytes_=100, depth=3).orderBy("seq").collect()]
    assert got == [(1, None), (2, "BYTES"), (3, None), (4, "DEPTH"), (5, None), (6, "PAGES")]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id) for r in retrieval.nearest(df, df.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding"), 5).orderBy("rank").collect()]
    q = rows[3][1]
    cos = lambda v: max(0.0, sum(a * b for a, b in zip(q, v)) / (sum(a * a for a in q) * sum(b * b for b in v)) ** 0.5)
    assert got == [i for i, v in sorted(((i, v) for i, v in rows if v and len(v) == 8), key=lambda r: (-round(cos(r[1]), 9), r[0]))[:5]]


def test_forms_of_a_page(spark):
    html = b"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><main><h1>Title</h1><p>Some <b>text</b> with <a href='/x'>a link</a> in it.</p><p><a href='/y'>More</a></p><aside>Ads</aside></main><footer>End</footer></body></html>"
    rows = {r.artifact_id: r for r in markup.markdown_forms(spark.createDataFrame([(1, bytearray(html)), (2, None)], "artifact_id bigint, raw_content binary")).collect()}
    assert "Home" in rows[1].raw and "End" in rows[1].raw and rows[1].clean == "# Title\n\nSome **text** with [a link](/x) in it.\n\n[More](/y)"
    assert rows[1].fit == "# Title\n\nSome **text** with [a link](/x) in it." and (rows[2].raw, rows[2].clean, rows[2].fit) == ("", "", "")
    links = markup.links(spark.createDataFrame([(1, "https://a.x/", bytearray(html))], "artifact_id bigint, url string, raw_content binary")).orderBy("position").collect()
    assert [(r.url, r.heading, r.paragraph) for r in links] == [("https://a.x/", "", ""), ("https://a.x/x", "Title", "Some text with a link in it."), ("https://a.x/y", "Title", "More")]


def test_table_forms(spark):
    html = b"<table><tr><th>A</th><th>A</th><th></th></tr><tr><td>1</td><td>x, y</td><td>2</td></tr></table><table><tr><td>p</td><td>q</td></tr></table>"
    one, two = markup.tables(spark.createDataFrame([(1, bytearray(html))], "artifact_id bigint, raw_content binary")).orderBy("table_index").collect()
    assert one.json == '[{"A": "1", "A_2": "x, y", "col": "2"}]' and one.csv == 'A,A,\r\n1,"x, y",2\r\n' and two.json == '[{"col_1": "p", "col_2": "q"}]'
