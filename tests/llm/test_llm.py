"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import contributor_caps, languages, near_duplicates, packing, pages, queries, repeated_lines, shells, splitting, subjects, tokens
from tests import oracle


@pytest.fixture(scope="module")
def duck(tiny):
    return oracle.connection(tiny)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tiny, duck, name):
    df = queries.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = oracle.rows_of(df, columns)
    if name in queries.ORACLE:
        assert got == oracle.sql_rows(duck, queries.ORACLE[name], columns)
    elif name.endswith("_found"):
        assert len(got) == len(set(got))


COLUMNS = {
    "p1_found": ["query_id", "id"], "p2_found": ["tbl", "rec_id", "line_no", "lang"], "p3_found": ["tbl", "chunk_a", "chunk_b"], "p4_found": ["artifact_id"], "p5_found": ["tbl", "rec_id"],
    "p6_found": ["chunk_id", "line_no"], "p7_found": ["artifact_id", "line_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, tiny, name):
    assert queries.QUERIES[name](spark, tiny).columns == COLUMNS[name]


# --- 1 ----------------------------------------------------------------------------------------

HITS = "id string, query_id string, chunk_id string, url string, score double, authority_score double, retrieved_at int, site string"
CHUNKS = "chunk_id string, source_url string, extra int"
LIMITS = "query_id string, max_per_domain int, max_domain_share double"


def test_caps(spark):
    hits = [
        ("a", "q", "c1", None, 0.1, 0.9, 1, "clash"), ("a", "q", "c1", None, 0.1, 0.2, 0, "clash"),  # the newest row counts
        ("b", "q", "c1", None, 0.9, None, 1, "x"), ("c", "q", "c1", None, 0.8, 1.5, 1, "x"), ("d", "q", "c2", None, 0.5, 0.1, 1, "x"),
        ("e", "q", None, "https://www.Own.example/x", None, None, None, "x"), ("f", "none", "c1", None, 0.5, 0.5, 1, "x"),
        ("g", "s", "c1", None, 0.5, 0.5, 1, "x"), ("h", "s", "c1", None, 0.5, 0.5, 1, "x"), (None, "q", None, None, None, None, None, None),
    ]
    chunks = [("c1", "https://www.one.example:80/a", 1), ("c1", "https://www.one.example:80/a", 1), ("c2", "http://two.example/b", 1)]
    limits = [("q", 1, None), ("s", None, 0.4), ("unused", 3, None)]
    rows = contributor_caps.rank_hits(spark.createDataFrame(hits, HITS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(limits, LIMITS)).collect()
    assert {r.id: (r.site, r.place, r.kept) for r in rows} == {
        "a": ("one.example", 0, True), "b": ("one.example", 1, False), "c": ("one.example", 2, False), "d": ("two.example", 0, True), "e": ("own.example", 0, True),
        "f": ("one.example", 0, True), "g": ("one.example", 0, True), "h": ("one.example", 1, False), None: (None, 0, True),
    }


def test_caps_with_one_dominant_site(spark):
    rng = random.Random(1)
    hits = [(f"h{i:04d}", "q", "c", None, rng.random(), rng.choice([0.1, 0.5, 0.5, None]), 1, None) for i in range(800)]
    rows = contributor_caps.rank_hits(spark.createDataFrame(hits, HITS), spark.createDataFrame([("c", "https://x.example/", 0)], CHUNKS), spark.createDataFrame([("q", 100, None)], LIMITS))
    best = sorted(hits, key=lambda h: (-(h[5] if h[5] is not None else -1), -h[4], h[0]))[:100]
    assert {r.id for r in rows.where("kept").collect()} == {h[0] for h in best}


def test_caps_of_empty_tables(spark):
    args = (spark.createDataFrame([], HITS), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], LIMITS))
    assert contributor_caps.rank_hits(*args).count() == 0


# --- 2 ----------------------------------------------------------------------------------------

SENTENCES = {
    "en": "The report of the commission was published in the spring and it describes what has been done since then.",
    "de": "Der Bericht der Kommission wurde im Frühjahr veröffentlicht und beschreibt, was seitdem getan worden ist.",
    "fr": "Le rapport de la commission a été publié au printemps et il décrit ce qui a été fait depuis cette date.",
    "es": "El informe de la comisión se publicó en la primavera y describe lo que se ha hecho desde entonces para ello.",
    "pt": "O relatório da comissão foi publicado na primavera e descreve o que não foi feito desde então pelo grupo.",
    "ru": "Доклад комиссии был опубликован весной, и в нём описано то, что было сделано с тех пор по этому вопросу.",
    "zh": "委员会的报告是在春天发表的，其中描述了从那时以来所做的工作，但是没有提到关于这个问题的其他方面的结果。",
}
LABELLED = "tbl string, rec_id bigint, text string, url string, label string, markup string, page boolean, lang string"


def test_languages(spark):
    rows = []
    for k, (lang, s) in enumerate(SENTENCES.items()):
        other = SENTENCES["ru" if lang != "ru" else "en"]
        rows.append(("documents", k, f"{s}\n{s}\n{other}", f"https://h{k}.example/x", lang.upper(), None, False, "clash"))
    rows += [("documents", 20, None, None, None, None, False, ""), ("documents", 21, " \n\u00a0\u3000", None, None, None, False, ""), ("documents", 22, "12 345 :", "https://a.example/", "fr-CA", None, False, ""), ("documents", 22, "12 345 :", "https://a.example/", "fr-CA", None, False, ""), ("documents", None, "x", None, None, None, False, "")]
    model = languages.learn([(s, lang) for lang, s in SENTENCES.items()])
    got = {(r.rec_id, r.line_no): r for r in languages.languages(spark.createDataFrame(rows, LABELLED), model, None).collect()}
    for k, lang in enumerate(SENTENCES):
        assert (got[k, -1].lang, got[k, -1].named) == (lang, lang)
        assert got[k, 2].lang == ("ru" if lang != "ru" else "en") and 0.5 < got[k, 2].confidence <= 1
        assert (k, 0) not in got and (k, 1) not in got
    assert got[22, -1].lang == "fr"  # no words: the label decides
    assert not {20, 21, None} & {k for k, _ in got}
    assert languages.languages(spark.createDataFrame([], LABELLED), model, None).count() == 0


def test_language_models_read_every_row(spark):
    """Words of single rows among more than any sample had: counts of a table equal those of the whole list."""
    texts = list(SENTENCES.items())
    rows = [(k, texts[k % 7][1] + f" qqq{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]}" * 3, texts[k % 7][0]) for k in range(6500)] + [(None, None, "en"), (6501, "short", None), (6501, " \n", None)]
    table = spark.createDataFrame([("documents", k, x, label) for k, x, label in rows], "tbl string, rec_id bigint, text string, label string").repartition(5)
    got, want = languages.fit(table), languages.learn([(x, label) for _, x, label in rows])
    assert (got.known == want.known).all() and (got.table == want.table).all()
    own = {languages.encode([x.split()[-1]])[0][0] for _, x, _ in rows[:6500]}
    assert got.known[list(own)].all() and len(own) > 6300  # of 6,500 words a few share a bucket
    assert languages.fit(table.where("rec_id < 0")).known.sum() == languages.learn([]).known.sum()  # no rows: the function words alone


def test_words_are_folded():
    a, b = (languages.encode([x])[0].tolist() for x in ("Été ЁЖ naïve Straße so\u00adft", "ete еж naive strasse soft"))
    assert a == b and len(a) == 5


@pytest.mark.parametrize(("label", "want"), [("FR", "fr"), ("fra", "fr"), ("fr-CA", "fr"), ("en_GB", "en"), ("deutsch", "de"), ("Русский", "ru"), (" es ", "es"), ("und", None), ("unknown", None), ("", None), (None, None)])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(languages.label_language(F.col("x")).alias("y")).first().y == want


# --- 3 ----------------------------------------------------------------------------------------

TEXTS = "tbl string, id string, text string, extra int"


def near_truth(rows):
    out = set()
    sets = [(t, i, near_duplicates.triples(x)) for t, i, x in {(t, i, x) for t, i, x, _ in rows if i and x}]
    for a in range(len(sets)):
        for b in range(a):
            (t, i, p), (u, j, q) = sets[a], sets[b]
            if t == u and i != j and (p or q) and len(p & q) >= 0.6 * len(p | q):
                out.add((t, min(i, j), max(i, j)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        rows.append(("rag_chunks", f"c{k}", " ".join(words), 1))
        for e in range(3):
            edited = list(words)
            for _ in range(e * 3):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((rng.choice(["rag_chunks", "structured_chunks"]), f"c{k}e{e}", ("X, " if e == 2 else "") + " ".join(edited).upper(), 1))
    rows += [("rag_chunks", "n", None, 0), ("rag_chunks", None, "a b c d", 0), ("rag_chunks", "s", "two words", 0), ("rag_chunks", "s2", "two words", 0), ("rag_chunks", "e", "", 0), rows[0], rows[1]]
    df = spark.createDataFrame(rows, TEXTS)
    got = [tuple(r) for r in near_duplicates.all_pairs(*near_duplicates.similar(df)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == near_truth(rows)


def test_many_copies(spark):
    rows = [("rag_chunks", f"c{i:03d}", "one and the same text of some seven words", 0) for i in range(60)] + [("rag_chunks", "z", "an other text that shares nothing at all", 0)]
    members, links = near_duplicates.similar(spark.createDataFrame(rows, TEXTS))
    assert links.count() == 0
    assert near_duplicates.all_pairs(members, links).count() == 60 * 59 // 2
    got = {r.id: (r.group, r.links) for r in near_duplicates.groups(members, links).collect()}
    assert got == {f"c{i:03d}": ("c000", 59) for i in range(60)} | {"z": ("z", 0)}


def ring_pairs(n=3000):
    rng = np.random.RandomState(3)
    a = rng.randint(0, 65536, (n, near_duplicates.N)).astype(np.uint16)
    b = np.where(rng.rand(n, near_duplicates.N) < rng.rand(n, 1), a, a ^ np.uint16(0x3333))
    differ = near_duplicates.segment_values(a) != near_duplicates.segment_values(b)
    return a, b, differ


def test_keys_agree_where_a_chain_is_viable():
    a, b, differ = ring_pairs()
    table = np.zeros(len(a), np.uint64)
    shared = (near_duplicates.chain_keys(a, table) == near_duplicates.chain_keys(b, table)).any(axis=1)
    alive = near_duplicates.viable(differ).any(axis=1)
    assert (shared == alive).all() and 0 < alive.sum() < len(a)
    within = differ.sum(axis=1) <= near_duplicates.BUDGET * near_duplicates.SEGMENTS
    for chain in (1, 2, near_duplicates.CHAIN, near_duplicates.SEGMENTS):
        assert near_duplicates.viable(differ, chain).any(axis=1)[within].all()  # the principle: no such pair is lost
    assert near_duplicates.viable(differ, 1).any(axis=1).sum() > alive.sum()  # longer chains rule pairs out


def test_hot_key_is_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [("rag_chunks", f"c{i:02d}", f"{shared} {rng.random()} x{i}", 0) for i in range(40)]
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    got = [tuple(r) for r in near_duplicates.all_pairs(*near_duplicates.similar(spark.createDataFrame(rows, TEXTS))).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2


def test_long_chain_of_links(spark):
    ids = [f"i{k:03d}" for k in range(130)]
    members = spark.createDataFrame([("t", i, 1, i) for i in ids], "tbl string, id string, same bigint, rep string")
    links = spark.createDataFrame([("t", a, b) for a, b in zip(ids, ids[1:])], near_duplicates.PAIRS)
    assert {r.group for r in near_duplicates.groups(members, links).collect()} == {"i000"}


def test_no_chunks(spark):
    members, links = near_duplicates.similar(spark.createDataFrame([], TEXTS))
    assert near_duplicates.all_pairs(members, links).count() == 0


# --- 4 and 7 ----------------------------------------------------------------------------------

PROSE = "The first results of the survey were compared with the records of the archive, and no difference was found between the two of them. It was also shown that the method is not without its limits."
FURNITURE = ["Home | Contact | Archive | Help", "We use cookies to measure visits and to remember your settings.", "Related reading", "Notes on old maps", "© 2011 Some Press. All rights reserved."]
ERRORS = ["404 - the page you asked for is not here. It may have been moved or removed.", "Access denied. You do not have permission to open this document.", "Too many requests from your network. Wait 3 minutes and try again.", "Please enable JavaScript to view this page.", "TODO: add summary\nTODO: add figure 2", "${title} ${author}\n${body} ${place} ${date}"]
PAGES = "artifact_id bigint, text_content string, raw_content binary, status_code int, url string, extra int"


def page_rows():
    rows = []
    for k in range(120):
        shell = k % 4 == 0
        main = ERRORS[k // 4 % len(ERRORS)] if shell else f"A title about topic {k}\n{PROSE} Case {k} was {'red' if k % 3 else 'blue'}."
        rows.append((k, "\n".join([*FURNITURE[:2], main, *FURNITURE[2:]]), None, 404 if shell and k % 8 == 0 else 200, f"https://h{k % 17}.example/{k}", 0))
    return rows


def test_shells(spark):
    rows = page_rows()
    quoted = "A note on errors\n" + PROSE + " One server said «Please try again later». " + PROSE
    rows += [(500, quoted, None, 200, "https://new.example/a", 0), (501, None, None, 200, None, 0), (502, "  \n", None, 200, None, 0), (503, "Home\nContact", None, 500, None, 0), (None, ERRORS[0], None, 404, None, 0), rows[0], (504, PROSE * 300, None, 404, None, 0)]
    df = spark.createDataFrame(rows, PAGES)
    model = shells.fit_pages(df)
    assert model.accuracy > 0.9
    assert sorted(r.artifact_id for r in shells.shell_pages(df, model).collect()) == [k for k in range(120) if k % 4 == 0]
    assert shells.fit_pages(df.where("false")) is None and shells.shell_pages(df.where("false"), None).count() == 0


def test_furniture_by_words():
    lines = [*FURNITURE[:2], "A title about maps", "By A. Writer | 7 min read", PROSE, "", "Recovery times: 36", "Some | 3 | 4.5", "Advertisement", PROSE, *FURNITURE[2:]]
    want = [1, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 1, 1]
    assert pages.roles(lines) == want


def test_furniture_by_paths(spark):
    html = "<html><head><meta charset='utf-8'><title>T of it</title></head><body><div><li><a href='/a'>Home</a></li><li><a href='/b'>Maps</a></li></div><div><h1>Maps of old</h1><p>{0}</p><li>Sheets</li><table><tr><td>A</td><td>1</td></tr></table><p>{0} More.</p></div><footer><p>Some words at the end.</p></footer></body></html>"
    text = f"Home\nMaps\nMaps of old\n{PROSE}\nSheets\nA | 1\n{PROSE} More.\nSome words at the end."
    rows = [(1, text, bytearray(html.format(PROSE).encode()), 200, None, 0), (1, text, bytearray(html.format(PROSE).encode()), 200, None, 0), (2, None, None, None, None, 0), (3, "", None, None, None, 0), (4, "Home\nMaps of old\n" + PROSE, bytearray(b"<p>broken <div"), None, None, 0)]
    df = spark.createDataFrame(rows, PAGES).withColumn("canonical_url", F.col("url"))
    got = {(r.artifact_id, r.line_no) for r in pages.furniture_lines(df).collect()}
    assert got == {(1, 0), (1, 1), (1, 7)}  # page 4: nothing in its markup, no model, one page only
    main = {r.artifact_id: (r.main_text, r.main_text_ratio) for r in pages.main_body(df).distinct().collect()}
    assert main[1][0].startswith("Maps of old\n") and 0.9 < main[1][1] < 1 and main[2] == (None, None) and main[3] == ("", None)


LAYOUT = "<html><head><title>{title}</title></head><body><!-- {long} --><div><li><a href='/a'>Home | Contact | Archive | Help</a></li></div><div><h1>{title}</h1><p>By A. Writer | 7 min read</p><p>{prose}</p><p>{prose}</p></div><div><p>We use cookies to measure visits and to remember your settings. {footer}</p><p>\u00a9 2011 Some Press. All rights reserved.</p></div></body></html>"


def layout_rows(n):
    rng = random.Random(4)
    for k in range(n):
        prose = [f"The {rng.choice(['first', 'second', 'third'])} results of survey {k} were compared with the {rng.choice(['records', 'sheets', 'maps'])} of the archive of place {rng.random()}, and no difference was found between them." for _ in range(2)]
        title, footer = f"A title about topic {k}", "Every visit counts, " * 20  # a long footer is still one
        markup = LAYOUT.format(title=title, prose="{0}", footer=footer, long="x" * 5000).replace("<p>{0}</p><p>{0}</p>", f"<p>{prose[0]}</p><p>{prose[1]}</p>")
        text = "\n".join(["Home | Contact | Archive | Help", title, "By A. Writer | 7 min read", *prose, f"We use cookies to measure visits and to remember your settings. {footer}".strip(), "\u00a9 2011 Some Press. All rights reserved."])
        yield k, text, bytearray(markup.encode("utf-16" if k == 7 else "utf-8")) if k % 10 else None, 200, f"https://h{k % 9}.example/{k}", f"https://h{k % 9}.example/{k}"


def test_words_are_learnt_from_tag_paths(spark, monkeypatch):
    for name in ("FURNITURE_STARTS", "MENU_WORDS"):
        monkeypatch.setattr(pages.lexicon, name, {})
    monkeypatch.setattr(pages.lexicon, "FURNITURE_ANYWHERE", ())
    rows = [r for r in layout_rows(60) if r[0] != 7]
    df = spark.createDataFrame(rows, "artifact_id bigint, text_content string, raw_content binary, status_code int, url string, canonical_url string")
    model = pages.fit_lines(df)
    assert model.agreement > 0.9
    got = {(r.artifact_id, r.line_no) for r in pages.furniture_lines(df, model).collect()}
    assert got == {(r[0], k) for r in rows for k in (0, 2, 5, 6)}  # pages without markup among them
    assert pages.fit_lines(df.where("false")) is None and pages.furniture_lines(df.where("false")).count() == 0
    main = {r.artifact_id: r for r in pages.main_body(df, model).collect()}
    assert main[0].main_text == "\n".join(rows[0][1].split("\n")[k] for k in (1, 3, 4)) and 0 < main[0].main_text_ratio < 1


def test_charset_after_a_long_preamble():
    assert pages.decoded(b"<!-- " + b"x" * 5000 + "--><meta charset='cp1251'><p>год".encode("cp1251")).endswith("год")


# --- 5 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "one", "word " * 700, "x" * 3000, "# A\n\n" + (PROSE + "\n\n") * 30 + "## B\n\n" + PROSE * 10, "好。" * 900, "没有空格的文字" * 200, "\n" * 900, ("a" * 50 + "\n") * 100])
@pytest.mark.parametrize(("limit", "overlap"), [(100, 10), (100, 0), (7, 3), (1, 0), (400, 40), (200, 150), (50, 49), (4, 3), (100, 500)])
def test_pieces(text, limit, overlap):
    spans = splitting.split(text, limit, overlap)
    assert all(splitting.tokens(text[a:b]) <= limit for a, b in spans)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert (len(spans) > 1) == (splitting.tokens(text) > limit)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and (c == b or splitting.tokens(text[c:b]) <= overlap)
        assert c < b or not overlap


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es", "pt", "ru", "zh"])
@pytest.mark.parametrize(("limit", "overlap"), [(120, 20), (120, 90)])
def test_overlap_is_kept_in_every_language(lang, limit, overlap):
    text = "\n\n".join(SENTENCES[lang] * 3 for _ in range(40))
    spans = splitting.split(text, limit, overlap)
    shared = [splitting.tokens(text[c:b]) for (_, b), (c, _) in zip(spans, spans[1:])]
    assert len(shared) > 10 and all(overlap // 2 - 3 <= n <= overlap for n in shared)


def test_an_edit_changes_only_near_pieces():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(6000))
    before = {text[a:b] for a, b in splitting.split(text, 200, 0)}
    edited = text[:3000] + "inserted words here " + text[3000:]
    after = [edited[a:b] for a, b in splitting.split(edited, 200, 0)]
    assert sum(p not in before for p in after) <= len(after) // 3


def test_split_items(spark):
    long = "# Top\n\n" + (PROSE + "\n\n") * 8 + "## Low\n\n" + (PROSE + "\n\n") * 8
    rows = [("extracted_content", "a", long, ["Given"], 100, 10, 1), ("extracted_content", "b", None, None, 100, 10, 1), ("extracted_content", "c", "", None, 100, 10, 1), ("extracted_content", "d", "short", None, None, None, 1)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, heading_path array<string>, limit_tokens int, overlap_tokens int, start int")
    got = splitting.split_items(df).orderBy("rec_id", "piece_no").collect()
    a = [r for r in got if r.rec_id == "a"]
    assert a[0].heading_path == ["Given", "Top"] and a[-1].heading_path == ["Given", "Top", "Low"] and all(r.token_estimate <= 100 for r in a)
    assert [r.rec_id for r in got if r.rec_id != "a"] == ["d"]


# --- 6 ----------------------------------------------------------------------------------------


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(9)
    common = ["Share this page", "© 2019  Some Site", "A longer legal notice that goes on and on for well over sixty-four characters, so that it is cut inside.", "x"]
    rows = []
    for i in range(120):
        lines = [f"own line {rng.random()}", rng.choice(common), rng.choice(common).upper(), f"Part {i} of 9"] + ([""] if i % 3 else ["rare notice"] * 2)
        rng.shuffle(lines)
        rows.append((f"c{i}", f"https://www.S{i % 3}.example:8080/{i}", "\n".join(lines), 1))
    rows += [rows[0], ("n", "https://s1.example/", None, 1), ("e", "https://s1.example/", "", 1), ("q", None, "Share this page", 1), (None, "https://s1.example/", "Share this page", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, source_url string, text string, site int")
    seen, places = defaultdict(set), []
    for chunk, url, text, _ in set(rows):
        if chunk and url and text:
            site = url.lower().split("/")[2].split(":")[0].removeprefix("www.")
            for k, raw in enumerate(text.split("\n")):
                if line := repeated_lines.normal(raw):
                    seen[site, line].add(chunk)
                    places.append((chunk, k, site, line))
    want = {(c, k) for c, k, site, line in places if len(seen[site, line]) >= 6}
    found = repeated_lines.repeated_lines(df)
    got = [(r.chunk_id, r.line_no) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    kept = {r.chunk_id: r.text for r in repeated_lines.without_lines(df.where("chunk_id is not null"), found).collect()}
    assert kept["n"] is None and kept["e"] == "" and "Share" not in (kept["c1"] or "")
    assert repeated_lines.repeated_lines(df.where("false")).count() == 0


# --- 8 and 9 ----------------------------------------------------------------------------------

ODD = [None, "", " ", "  ", "\n\n x\t\ty ", "it's we'll I'm they've don't 'tis 's ''re x's!'s", "<|endoftext|> a", "12½ Ⅷ 3a b_c", "é​à　c", "好的，谢谢。 ok", "a" * 5000, "\r\n a", "'", "don'", "x '", "😀😀 👨‍👩‍👧", "\x00\x1c\x85 a", "' s", "'re're 'l 'll"]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(11)
    alphabet = "ab'sredl 12.,\n\t-é好ß 　​"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [got[k] for k in range(len(texts))] == [w.ids for w in want]
    coded = tokens.encode_texts(df, offsets=True)
    coder = tokens.encoder(tokens.VOCABULARY)
    for r in coded.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert [raw[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(raw)])] == [coder.bytes[k] for k in r.ids]
    assert {r.doc_id: r.text for r in tokens.decode_texts(coded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode_texts(df.where("false")).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 10, 100, 1024, 4096])
def test_plan(capacity):
    rng = np.random.RandomState(capacity)
    sizes = rng.randint(1, capacity + 1, 3000)
    lengths, counts = np.unique(sizes, return_counts=True)
    filled, ranks = defaultdict(int), defaultdict(list)
    for length, rank, n, first in packing.plan(lengths, counts, capacity):
        ranks[length] += range(rank, rank + n)
        for c in range(first, first + n):
            filled[c] += length
    assert max(filled.values()) <= capacity
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in zip(lengths, counts)}
    assert len(filled) <= max(sizes.sum() / capacity * 1.25, 3)


def test_pack(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 3, 5, 7, 7, 7, 10, 25])) for i in range(400)] + [(900, None), (1, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("position", F.lit(1))
    got = packing.pack(df, {"small": 10, "large": 30, "none": 0}).collect()
    for kind, capacity in (("small", 10), ("large", 30)):
        own = [r for r in got if r.container_type == kind]
        assert all((r.container_id == -1) == (not r.n_tokens) for r in own)
        filled, total = defaultdict(int), defaultdict(int)
        for r in own:
            filled[r.container_id] += r.n_tokens
            total[r.doc_id] += r.n_tokens
            assert r.first_token == r.piece_no * capacity
        assert max(filled.values()) <= capacity
        assert total == {i: sum(n or 0 for j, n in rows if j == i) for i in {i for i, _ in rows}}
        free: list[int] = []  # first fit, longest first
        for n in sorted((r.n_tokens for r in own), reverse=True):
            k = next((k for k, f in enumerate(free) if f >= n), None)
            if k is None:
                free.append(capacity - n)
            else:
                free[k] -= n
        assert len(filled) <= len(free) * 1.02 + 1
        assert all(len({r.piece_no for r in own if r.doc_id == i}) == max(1, -(-(n or 0) // capacity)) for i, n in rows if i != 1)
    assert packing.pack(df.where("false"), {"small": 10}).count() == 0 and packing.pack(df, {}).count() == 0


# --- 10 ---------------------------------------------------------------------------------------


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(13)
    terms = {"law": ["court", "judge", "contract", "appeal", "statute"], "sport": ["match", "team", "goal", "coach", "league"], "software": ["code", "compiler", "database", "server", "thread"]}
    sentence = lambda s: f"In most cases the {rng.choice(terms[s])} and the {rng.choice(terms[s])} were compared with a {rng.choice(terms[s])} of {rng.randint(1, 99)}."
    docs, labels, truth = [], [], {}
    for i in range(300):
        main = rng.choice(list(terms))
        text = [sentence(main) for _ in range(8)]
        truth[i] = {main}
        if i % 5 == 4:
            other = rng.choice([s for s in terms if s != main])
            text[4:] = [sentence(other) for _ in range(4)]
            truth[i].add(other)
        docs.append((i, " ".join(text), "clash"))
        if i < 90:
            labels += [(i, x) for x in sorted(truth[i])]  # documents with two subjects have two labels
    docs += [(900, None, ""), (901, "  ", ""), (902, "12 34", ""), (None, sentence("law"), "")]
    labels += [(0, None), (1, "no subject"), (5000, "law")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    model = subjects.fit(d, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s,) for s in terms], "subject string"))
    got = defaultdict(set)
    for r in subjects.subject_shares(d, model).where(F.col("share") >= subjects.SHARE).collect():
        got[r.doc_id].add(r.subject)
    held = [i for i in range(90, 300)]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert not {900, 901, 902, None} & set(got)
    few = subjects.fit(d, spark.createDataFrame(labels[:3], "doc_id bigint, subject string"), spark.createDataFrame([(s,) for s in terms], "subject string"))
    assert few is not None  # fewer labelled documents than slices
    empty = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.fit(d, empty, spark.createDataFrame([("law",)], "subject string")) is None
    assert subjects.subject_shares(d, None).count() == 0


def test_scoring_in_rows_equals_single_texts():
    """Sentences, tokens, scores and shares of many texts in a row, against one text at a time by the plain expressions."""
    split = re.compile(r"(?<=[^\sA-ZА-ЯЁ][.!?…])\s+|(?<=[。！？])|\n+")
    rng = random.Random(8)
    word = lambda: rng.choice(["Haus", "ёлка", "naïve", "x½", "ΣΑΣ", "中文", "𐐀b", "a\0b", "Dr", "…", "12", "İ", "_", "longerword"])
    texts = ["".join(word() + rng.choice([" ", ". ", ".", "!\n ", "\n\n", "。", "。\n", "Q. ", "…\t"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    own = [subjects.sentences(t) for t in texts]
    assert own == [[s for s in split.split(t) if s and not s.isspace()] for t in texts]
    flat = [s for x in own for s in x]
    words = subjects.Vocabulary()
    numbers, ends = words.numbers(flat)
    names = {n: w for w, n in words.items()}
    assert [[names[n] for n in x] for x in np.split(numbers, ends[:-1])] == [subjects._TOKEN.findall(s.lower()) for s in flat]
    random_ = np.random.RandomState(2)
    model = subjects.Model(["a", "b", "c"], random_.normal(0, 1, (subjects.BUCKETS, 3)).astype(np.float32), np.full(3, -0.5))
    scores = model.reader().scores(flat)
    assert np.allclose(scores, model.scores(*subjects.encode(flat, subjects.Vocabulary())), atol=1e-5)
    sizes, chars = np.array([len(x) for x in own]), np.array([len(s) for s in flat])
    some = sizes > 0
    got = iter(subjects.shares_of(scores, chars, sizes[some]))
    for s, c in zip(np.split(scores, np.cumsum(sizes)[:-1]), np.split(chars, np.cumsum(sizes)[:-1])):
        assert not len(c) or (next(got) == subjects.shares(s, c)).all()


def test_texts_are_searched_once_in_a_row(monkeypatch):
    """Not once for each sentence."""
    calls = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            calls.append(len(text))
            return self.pattern.findall(text)

    plain = subjects._tokens(False)
    monkeypatch.setattr(subjects, "_tokens", lambda beyond: Counted(plain))
    numbers, ends = subjects.Vocabulary().numbers(["one two", "", "three"] * 100)
    assert len(calls) == 1 and len(numbers) == 300 and len(ends) == 300
