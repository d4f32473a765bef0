from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import media
from tessera.plans import research
from tessera.sources import pdf, providers, sinks

ANSWERS = "query_id string, goal_id string, body string"


def answers(spark, *bodies):
    return spark.createDataFrame([("q", "g", b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies], ANSWERS)


def test_openalex(spark):
    works = [
        {"id": "W1", "doi": "https://doi.org/1", "title": "A review of x", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "publication_year": 2020, "cited_by_count": 151, "type": "article"},
        {"id": "W2", "doi": None, "title": None, "abstract_inverted_index": None, "publication_year": None, "cited_by_count": None, "type": "dataset", "open_access": {"oa_url": "https://oa"}},
    ]
    rows = providers.openalex(answers(spark, {"results": works}, "no json", None)).orderBy("provider_rank").collect()
    assert [(r.url, r.snippet, r.source_type, r.authority_prior) for r in rows] == [("https://doi.org/1", "a b a", "SYSTEMATIC_REVIEW", 0.99), ("https://oa", "Published in N/A, Cited by 0 researchers.", "DATASET", 0.93)]
    assert rows[1].title == "Scientific Work"


def test_other_services(spark):
    crossref = providers.crossref(answers(spark, {"message": {"items": [{"DOI": "10.1/x", "title": ["T"], "abstract": "<jats:p>Ab</jats:p>", "is-referenced-by-count": 51, "container-title": ["J"], "type": "book-chapter", "published": {"date-parts": [[2019, 1]]}}, {"title": ["no doi"]}]}})).collect()
    assert [(r.url, r.snippet, r.source_type, r.authority_prior, r.published_at) for r in crossref] == [("https://doi.org/10.1/x", "[J, 2019] Ab", "BOOK_CHAPTER", 0.98, "2019")]
    scholar = providers.semantic_scholar(answers(spark, {"data": [{"paperId": "p", "title": "T", "abstract": None, "year": 2001, "citationCount": 21, "publicationTypes": ["MetaAnalysis"], "venue": "V", "externalIds": {"ArXiv": "1"}}]})).collect()
    assert [(r.url, r.snippet, r.source_type, r.authority_prior) for r in scholar] == [("https://www.semanticscholar.org/paper/p", "[V, 2001] ", "SYSTEMATIC_REVIEW", 0.95)]
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/1</id><title>A\n  b</title><summary> s  t </summary><published>2020-01-01</published></entry></feed>"
    assert [(r.url, r.title, r.snippet) for r in providers.arxiv(answers(spark, atom)).collect()] == [("http://arxiv.org/abs/1", "A b", "s t")]
    pmc = providers.europe_pmc(answers(spark, {"resultList": {"result": [{"pmcid": "PMC1", "pmid": "2", "title": "T"}, {"pmid": "2"}, {"doi": "10.1/y"}, {"title": "none"}]}})).collect()
    assert [r.url for r in pmc] == ["https://europepmc.org/article/PMC/PMC1", "https://europepmc.org/article/MED/2", "https://doi.org/10.1/y"]
    assert [r.title for r in providers.pubmed(answers(spark, {"esearchresult": {"idlist": ["7"]}})).collect()] == ["NCBI PMC Article 7"]
    assert [(r.url, r.snippet) for r in providers.wikipedia(answers(spark, ["q", ["A", "B"], ["s"], ["u1", "u2"]])).collect()] == [("u1", "s"), ("u2", "")]
    assert [r.title for r in providers.github(answers(spark, {"items": [{"html_url": "h", "full_name": "a/b"}]})).collect()] == ["GitHub: a/b"]
    web = providers.general(answers(spark, {"results": [{"url": "ftp://x"}, {"url": "https://arxiv.org/1"}, {"url": "https://z"}]}), most=1).collect()
    assert [(r.url, r.provider_rank, r.source_type) for r in web] == [("https://arxiv.org/1", 2, "PRIMARY_RESEARCH")]


def test_regional_and_web_pages(spark):
    hal = {"response": {"docs": [{"uri_s": "https://hal.x/1", "title_s": ["T"], "abstract_s": ["A"], "producedDateY_i": 2020, "doiId_s": "10.1/a"}, {"uri_s": "https://hal.x/2"}, {"uri_s": ""}]}}
    cis = {"articles": [{"link": "/article/n/1", "name": "", "annotation": "B", "year": None, "journal": "J"}, {"link": None}]}
    rows = providers.regional(answers(spark, hal, cis, "bad")).orderBy(F.desc("authority_prior"), "provider_rank").collect()
    assert [(r.url, r.title, r.snippet, r.authority_prior) for r in rows[:1]] == [("https://doi.org/10.1/a", "T", "[HAL EU Repository] A", 0.91)]
    assert (rows[-1].url, rows[-1].title, rows[-1].snippet, rows[-1].authority_prior) == ("https://cyberleninka.ru/article/n/1", "Научная статья", "[J, ] B", 0.90)
    assert {r.url for r in providers.regional(answers(spark, hal, cis), most=2).collect()} == {"https://doi.org/10.1/a", "https://hal.x/2"}
    blocks = "<div class='result'><h2 class='result__title'><a href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.x%2F1&x=1'>One <b>two</b></a></h2><a class='result__snippet' href='z'>First <b>text</b></a></div><div><a class='result__snippet'>No title</a></div><div><h2 class='result__title'><a href='https://b.y/'>B</a></h2><div class='result__snippet'>S</div></div>"
    table = "<table><tr><td><a class='result-link' href='https://c.z/'>C</a></td></tr><tr><td class='result-snippet'>Text of c</td></tr><tr><td><a class='result-link' href='ftp://d'>D</a></td></tr></table>"
    got = providers.web_results(answers(spark, blocks)).orderBy("provider_rank").collect()
    assert [(r.url, r.title, r.snippet, r.provider_rank) for r in got] == [("https://a.x/1", "One two", "First text", 1), ("https://b.y/", "B", "S", 3)]
    assert [(r.url, r.title, r.snippet, r.provider_rank) for r in providers.web_results(answers(spark, table, None)).collect()] == [("https://c.z/", "C", "Text of c", 1)]


def test_image_answers(spark):
    pages = {"1": {"title": "File:A_map.png", "imageinfo": [{"url": "https://u/a.png", "width": 900, "height": 600, "extmetadata": {"ImageDescription": {"value": "<b>Old map</b>"}, "Artist": {"value": "<i>N</i>"}}}]}, "2": {"title": "Maps", "thumbnail": {"source": "https://u/t.png", "width": 10, "height": 20}}, "3": {"title": "none"}}
    rows = {r.url: r for r in providers.image_answers(answers(spark, {"query": {"pages": pages}}, "x")).collect()}
    assert (rows["https://u/a.png"].caption, rows["https://u/a.png"].alt, rows["https://u/a.png"].author, rows["https://u/a.png"].license) == ("Old map", "A map.png", "N", "UNKNOWN_LICENSE")
    assert rows["https://u/t.png"].caption == "Maps - Main Diagram/Photo" and len(rows) == 2


def test_pool_falls_back(spark):
    none = spark.createDataFrame([], "url string, pos int")
    some = spark.createDataFrame([("u", 0)], "url string, pos int")
    assert [r.url for r in providers.pool(none, none, "spare").collect()] == ["spare"]
    assert [r.url for r in providers.pool(none, some, "spare").collect()] == ["u"]


def test_tables_by_version_and_queue(spark, tmp_path):
    steps = [lambda _: spark.range(3).toDF("id"), lambda t: t.withColumn("x", F.col("id") * 2)]
    base = str(tmp_path / "t")
    assert sinks.migrate(spark, base, steps).columns == ["id", "x"] and sinks.migrate(spark, base, steps, 1).columns == ["id"]
    queue, new = spark.range(3), spark.createDataFrame([(i,) for i in range(5)], "seq int")
    assert {r.seq: r.pushed for r in sinks.push(queue, new, 5).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    sinks.markdown_files(spark.createDataFrame([("a", "# A"), ("b", "B")], "name string, content string"), str(tmp_path / "md"))
    assert (tmp_path / "md" / "a.md").read_text() == "# A"
    lines = tmp_path / "lines.json"
    lines.write_text('{"id": "1"}\nnot json\n')
    assert sorted((r.id, r._corrupt_record) for r in providers.json_lines(spark, str(lines), "id string").cache().collect() if r.id) == [("1", None)]
    assert providers.json_lines(spark, str(lines), "id string").cache().where("_corrupt_record is not null").count() == 1


def test_discover_keeps_the_first_of_each_address(spark):
    one = answers(spark, {"items": [{"html_url": "https://a.x/1", "full_name": "n"}, {"html_url": "https://b.y/2", "full_name": "m"}]})
    two = answers(spark, {"results": [{"url": "https://a.x/1", "title": "T"}, {"url": "https://sub.a.x/3", "title": "T"}]})
    kept, report = providers.discover({"github": one, "general": two})
    assert {(r.url, r.provider) for r in kept.collect()} == {("https://a.x/1", "github"), ("https://b.y/2", "github"), ("https://sub.a.x/3", "general")}
    assert {(r.provider, r.found, r.kept) for r in report.collect()} == {("github", 2, 2), ("general", 2, 1)}
    near, _ = providers.discover({"github": one, "general": two}, domain="a.x", opt_in=("github",))
    assert {r.url for r in near.collect()} == {"https://a.x/1", "https://sub.a.x/3"}


def test_seeds_and_rescue(spark):
    a, b = spark.createDataFrame([("u1", 0), ("u2", 1)], "url string, pos int"), spark.createDataFrame([("u2", 0), ("u3", 1), (None, 2)], "url string, pos int")
    assert [(r.url, r.origin) for r in providers.merged_seeds(a, b).orderBy("origin", "pos").collect()] == [("u1", 0), ("u2", 0), ("u3", 1)]
    pages = spark.createDataFrame([("https://doi.org/10.1234/Ab", "T"), ("https://x", "Known"), ("https://y", None)], "url string, title string")
    by_doi, by_title = spark.createDataFrame([("10.1234/ab", "", "land")], "doi string, pdf_url string, landing_url string"), spark.createDataFrame([("known", "pdf", None)], "title string, pdf_url string, landing_url string")
    assert {r.url: r.rescue_url for r in providers.open_access(pages, by_doi, by_title).collect()} == {"https://doi.org/10.1234/Ab": "land", "https://x": "pdf", "https://y": None}


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "https://a.b/c", 'T "x"', "Text\nmore"), (2, None, "", None)], "n int, url string, title string, markdown string")
    notes = {r.name: r.content for r in sinks.notes(docs, "q", "2025-01-01").collect()}
    assert "01_t-x" in notes and "domain: a.b" in notes["01_t-x"] and "No content extracted." in notes["02_source-2"]
    one, two = sinks.citations(docs, "q", "2025-01-02").orderBy("n").collect()
    assert json.loads(one.csl)["accessed"] == {"date-parts": [[2025, 1, 2]]} and "AB  - Text more" in one.ris and json.loads(two.csl)["title"] == "Document 2"
    chunks = spark.createDataFrame([("c", "u", None, "t", "text\x00", 1, 0.5, ["A", "B"], {"k": "v"})], "chunk_id string, source_url string, canonical_url string, title string, text string, token_estimate int, relevance_score double, heading_path array<string>, provenance map<string,string>")
    path = str(tmp_path / "json")
    sinks.write_json(sinks.dataset_rows(chunks, "q"), path)
    assert providers.json_lines(spark, path, "id string, text string, metadata struct<domain:string>").first().metadata.domain == "Global"
    assert sinks.context_text(chunks).first().value.startswith("## t — A > B")
    assert sinks.manifest(docs, chunks, docs, docs.limit(0), docs).first().asDict() == {"total_documents": 2, "total_chunks": 1, "total_nodes": 2, "total_edges": 0, "total_rejections": 2}
    assert sinks.deterministic_zip(path, str(tmp_path / "a.zip")) == sinks.deterministic_zip(path, str(tmp_path / "b.zip"))


def test_content_store_writes_once(spark, tmp_path):
    path = str(tmp_path / "cas")
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),), (None,)], "content binary")
    assert sinks.store_contents(df, path).count() == 2
    assert spark.read.parquet(path).count() == 2
    sinks.store_contents(df, path)
    assert spark.read.parquet(path).count() == 2
    hashes = spark.range(1).select(F.sha2(F.lit(b"b"), 256).alias("content_hash"))
    assert [bytes(r.content) for r in sinks.read_contents(spark, path, hashes).collect()] == [b"b"]


def test_upsert_and_delete(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 5, "stay")], "document_id string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", None, "add")], "document_id string, v int, x string")
    out = sinks.upsert(now, new, "document_id", "v")
    assert {r.document_id: r.x for r in out.collect()} == {"a": "new", "b": "stay", "c": "add"}
    assert sinks.delete_documents(out, new.where("document_id = 'a'")).count() == 2


def test_research(spark):
    assert [e.kind for e in research.entities("UF_DRAW_2512 per ГОСТ 2.104 and 10.1234/abc v1.2")][:3] == ["DOI", "STANDARD", "SOFTWARE_API"]
    names = {e.name: e.kind for e in research.entities("metformin and insulin for diabetes, ISO 9001")}
    assert names["metformin"] == "CHEMICAL" and names["diabetes"] == "DISEASE" and names["ISO 9001"] == "STANDARD"
    q = research.normalise('  find "exact phrase"  ＡＢＣ по теме UF_DRAW_2512 ')
    assert q.quoted == ["exact phrase"] and "UF_DRAW_2512" in q.identifiers and q.languages == ["en", "ru"] and "ABC" in q.text
    asked = "SLA vs DLP printing"
    targets = research.goals(asked)
    assert [g.question for g in targets] == ["Answer primary research question: SLA vs DLP printing", "Investigate characteristics and properties of SLA", "Investigate characteristics and properties of DLP printing"]
    assert targets[0].depends == () and targets[2].depends == ("g1",) and targets[0].required_types == research.PLAIN_EVIDENCE
    made = research.variants(asked, targets)
    assert [(v.query, v.kind) for v in made] == [(asked, "SEMANTIC"), (f"{asked} {research.STUDIES}", "PRIMARY_SOURCE")]  # the other goals ask the same
    disputed = research.goals("risk of metformin for diabetes per ISO 9001")
    assert [g.importance for g in disputed] == [1.0, 0.9, 0.9] and disputed[0].required_types == research.MEDICAL_EVIDENCE and "ISO 9001" in disputed[2].question
    software = research.goals("python sdk")[0]
    assert software.required_types == research.SOFTWARE_EVIDENCE
    russian = research.variants("лазерная резка титана", research.goals("лазерная резка титана"))
    assert [v.language for v in russian] == ["ru", "en", "en"] and "titanium alloy" in russian[1].query
    plan = research.plan_requests("insulin trial", disputed[0], [research.Variant("insulin trial", "g1")])
    assert [r[0] for r in plan] == ["pubmed", "europe_pmc", "semantic_scholar", "openalex", "crossref", "arxiv", "regional", "general"] and plan[0][2] == 12
    hinted = research.plan_requests("a", research.Goal("g1", "q", 1.0), [research.Variant("a", "g1", service="regional"), research.Variant("b", "g1", service="regional")], pool=4)
    assert [r[0] for r in hinted[:2]] == ["regional", "semantic_scholar"] and len(hinted) == 8 and hinted[0][2] == 5
    assert "github" in [r[0] for r in research.plan_requests("x", software, [research.Variant("x", "g1")], most=9)]
    assert [v.query for v in research.followups(["  maps ", "abc", "карты", "late"], "q")] == ["q maps", "q карты"]
    df = spark.createDataFrame([("metformin 10.1234/x",), (None,)], "t string").select(research.entity_column(F.col("t")).alias("e"))
    assert [[(x.kind, x.name) for x in r.e] for r in df.collect()] == [[("DOI", "10.1234/x"), ("VERSION", "10.1234"), ("CHEMICAL", "metformin")], []]
    assert spark.range(1).select(research.translated(F.lit("a b"), [("a", "x"), ("b", "y")]).alias("t")).first().t == "x y"


def test_media(spark):
    html = b"<head><meta property='og:image' content='/og.png'></head><img src='a.jpg' srcset='s.jpg 100w, l.jpg 900w' alt='A red map' width=700 height=500><img src='data:x'><picture><source srcset='p.webp 2x'></picture><img>"
    df = spark.createDataFrame([(1, "https://s.x/p/", bytearray(html)), (2, None, None)], "artifact_id bigint, url string, raw_content binary")
    rows = media.images(df).orderBy("position").collect()
    assert [(r.url, r.origin, r.width) for r in rows] == [("https://s.x/og.png", "meta", None), ("https://s.x/p/l.jpg", "img", 700), ("https://s.x/p/p.webp", "picture", None)]
    pictures = media.images(df).select(F.lit("q").alias("query_id"), F.lit("red map").alias("query"), "url", "position", F.lit("").alias("caption"), "alt", F.lit("en.wikipedia.org").alias("source_domain"), F.lit(False).alias("primary"), "width", "height")
    assert [(r.url, r.relevance, r.place) for r in media.ranked_images(pictures).collect()] == [("https://s.x/p/l.jpg", 1.0, 0)]
    no_query = pictures.withColumn("query", F.lit(""))
    assert [r.url for r in media.ranked_images(no_query).orderBy("place").collect()] == ["https://s.x/p/l.jpg", "https://s.x/p/p.webp", "https://s.x/og.png"]
    kinds = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"RIFF1234WEBP"),), (bytearray(b"%PDF-1.4"),), (bytearray(b"<html>"),), (None,)], "c binary").select(media.magic_kind(F.col("c")).alias("k")).collect()
    assert [r.k for r in kinds] == ["jpg", "webp", "pdf", None, None]
    links = spark.createDataFrame([(1, "https://a/x.pdf?y"), (1, "https://arxiv.org/abs/7.1v2"), (1, "https://a/x")], "artifact_id bigint, url string")
    pages = spark.createDataFrame([(2, "https://x/articles/pmc123/"), (3, None)], "artifact_id bigint, url string")
    assert {(r.artifact_id, r.url) for r in media.document_files(links, pages).collect()} == {(1, "https://a/x.pdf?y"), (1, "https://arxiv.org/pdf/7.1v2.pdf"), (2, "https://europepmc.org/backend/ptpmcrender.fcgi?accid=PMC123&blobtype=pdf")}
    cover = media.tiles(spark.createDataFrame([(1, 1000, 300), (2, 0, 5)], "id int, width int, height int")).collect()
    assert {(r.x, r.tile_width) for r in cover} == {(0, 512), (448, 512), (896, 104)} and {r.tile_height for r in cover} == {300}
    assert spark.range(1).select(media.media_name(F.lit("https://a/b.PNG?x"), F.lit("A b")).alias("n")).first().n.startswith("a-b_")


def test_robots_and_addresses(spark):
    urls = spark.createDataFrame([("h", "/a/b"), ("h", "/a/public/x"), ("h", "/z"), ("other", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a/", False), ("h", "/a/public", True)], "host string, prefix string, allow boolean")
    assert {(r.host, r.path): r.allowed for r in media.robots_allowed(urls, rules).collect()} == {("h", "/a/b"): False, ("h", "/a/public/x"): True, ("h", "/z"): True, ("other", "/a"): True}
    ips = spark.createDataFrame([("::1",), ("::ffff:10.0.0.1",), ("2606:4700::1111",), ("8.8.8.8",), ("x",), (None,)], "a string")
    assert [r.b for r in ips.select(media.blocked_ip(F.col("a")).alias("b")).collect()] == [True, True, False, False, None, None]


def _pdf(pages, deflate):
    """A small PDF: a catalogue, a page tree, a page and a content stream each."""
    import zlib

    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj".encode()]
    out.append(b"3 0 obj << /Type /Font /ToUnicode 4 0 R >> endobj")
    table = b"2 beginbfchar <0001> <0416> <0103> <0438> endbfchar 1 beginbfrange <0201> <0203> <0061> endbfrange"
    out.append(b"4 0 obj << /Length 9 >> stream\n" + table + b"\nendstream endobj")
    for k in reversed(range(len(pages))):
        body = zlib.compress(pages[k]) if deflate else pages[k]
        out.append(f"{10 + 2 * k} 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {11 + 2 * k} 0 R >> endobj".encode())
        out.append(f"{11 + 2 * k} 0 obj << /Length {len(body)}{' /Filter /FlateDecode' if deflate else ''} >> stream\n".encode() + body + b"\nendstream endobj")
    return b"\n".join(out) + b"\n%%EOF"


def test_pdf_texts(spark):
    pages = [b"BT /F2 12 Tf 10 700 Td (Hello \\(old\\) wor) Tj [(ld) -300 (again)] TJ 0 -14 Td (Line two\\056) Tj ET", b"q Q", b"BT /F1 9 Tf <000101030201> Tj T* <02020203> Tj ET"]
    want = "## Page 1\n\nHello (old) world again\nLine two.\n\n## Page 3\n\nЖиa\nbc"
    rows = [(1, bytearray(_pdf(pages, False))), (2, bytearray(_pdf(pages, True))), (3, bytearray(b"<html>")), (4, None), (5, bytearray(b"%PDF-1.4 broken")), (6, bytearray(_pdf(pages, True)[:200]))]
    got = {r.id: r.text for r in pdf.pdf_texts(spark.createDataFrame(rows, "id bigint, content binary")).collect()}
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "", 6: ""}
    assert pdf.pdf_text(_pdf(pages, True), pages=1, page_chars=5) == "## Page 1\n\nHello"
