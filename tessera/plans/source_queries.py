"""Queries over service answers, exports and controls that the other modules don't reach.

Answers of services are written from the hits in each service's own form and read back, so that every
reader is checked on whole tables. What writes files writes below the shared folder and reads back.
"""

from __future__ import annotations

import atexit
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.operators import acquisition, classify, graphs, media, metrics, ranking, retrieval
from tessera.plans import research, text_queries
from tessera.plans import sql as S
from tessera.plans.ranking_queries import _CALLS, _HITS, _calls, hits
from tessera.session import remove, shared_dir
from tessera.sources import pdf, providers, sinks, table


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Hits with title, text and address, and a number n that follows from the id."""
    return hits(spark, d).where("title is not null and text is not null and url is not null").withColumn("n", F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"))


def _answers(rows: DataFrame, body: Column) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), F.col("query_id").alias("goal_id"), body.alias("body"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "provider_rank", "url", F.md5("title").alias("title"), F.md5("snippet").alias("snippet"), "source_type", "published_at", "authority_prior")


# --- services -----------------------------------------------------------------------------------


def crossref_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d)
    item = F.struct(
        F.concat(F.lit("10.5/"), "id").alias("DOI"), F.array("title").alias("title"), F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>]", ""), F.lit("</p>")).alias("abstract"), F.pmod("n", F.lit(100)).alias("is-referenced-by-count"),
        F.array("source_type").alias("container-title"), F.when(F.pmod("n", F.lit(3)) == 0, "book-chapter").otherwise("journal-article").alias("type"), F.struct(F.array(F.array(2000 + F.pmod("n", F.lit(20)))).alias("date-parts")).alias("published"),
    )
    return _told(providers.crossref(_answers(rows, F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))))))


def semantic_scholar_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d)
    item = F.struct(
        F.col("id").alias("paperId"), "title", F.col("text").alias("abstract"), (2000 + F.pmod("n", F.lit(20))).alias("year"), F.pmod("n", F.lit(150)).alias("citationCount"), F.pmod("n", F.lit(13)).alias("influentialCitationCount"), F.col("source_type").alias("venue"),
        F.array(F.when(F.pmod("n", F.lit(4)) == 0, "Review").otherwise("JournalArticle")).alias("publicationTypes"), F.when(F.pmod("n", F.lit(2)) == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("10.6/"), "id"))).alias("externalIds"),
    )
    return _told(providers.semantic_scholar(_answers(rows, F.to_json(F.struct(F.array(item).alias("data"))))))


def arxiv_results(spark: SparkSession, d: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N} ]", "")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    entry = tag("entry", F.concat(tag("id", F.concat(F.lit("http://arxiv.org/abs/"), "id")), tag("title", F.concat(F.lit("A "), plain("title"), F.lit(" .  z"))), tag("summary", F.concat(F.lit("S "), plain("text"))), tag("published", F.lit("2020-01-02"))))
    return _told(providers.arxiv(_answers(_known(spark, d), F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), entry, F.lit("</feed>")))))


def europe_pmc_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d)
    pick = F.pmod("n", F.lit(4))
    item = F.struct(F.when(pick == 0, F.concat(F.lit("PMC"), "id")).alias("pmcid"), F.when(pick == 1, F.col("id")).alias("pmid"), F.when(pick == 2, F.concat(F.lit("10.7/"), "id")).alias("doi"), "title", F.col("text").alias("abstractText"), F.lit("1999").alias("pubYear"))
    return _told(providers.europe_pmc(_answers(rows, F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("resultList"))))))


def pubmed_results(spark: SparkSession, d: str) -> DataFrame:
    return _told(providers.pubmed(_answers(_known(spark, d), F.to_json(F.struct(F.struct(F.array("id", "query_id").alias("idlist")).alias("esearchresult"))))))


def wikipedia_results(spark: SparkSession, d: str) -> DataFrame:
    """The second entry has no snippet of its own."""
    j = lambda *c: F.to_json(F.array(*c))
    body = F.concat(F.lit('["q",'), j("title", "source_type"), F.lit(","), j("text"), F.lit(","), j("url", F.concat("url", F.lit("#2"))), F.lit("]"))
    return _told(providers.wikipedia(_answers(_known(spark, d), body)))


def github_results(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("url").alias("html_url"), F.col("title").alias("full_name"), F.when(F.pmod("n", F.lit(2)) == 0, F.col("text")).alias("description"), F.lit("2021-05-06").alias("updated_at"))
    return _told(providers.github(_answers(_known(spark, d), F.to_json(F.struct(F.array(item).alias("items"))))))


def regional_results(spark: SparkSession, d: str) -> DataFrame:
    """Every hit in the first hub, every other one in the second as well; three places of a query's answers count."""
    rows = _known(spark, d)
    one = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("url").alias("uri_s"), F.array("title").alias("title_s"), F.array("text").alias("abstract_s"), F.lit(2001).alias("producedDateY_i"), F.when(F.pmod("n", F.lit(2)) == 0, F.concat(F.lit("10.8/"), "id")).alias("doiId_s"))).alias("docs")).alias("response")))
    two = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("/article/"), "id").alias("link"), F.col("title").alias("name"), F.col("text").alias("annotation"), F.lit(2002).alias("year"), F.lit("J").alias("journal"))).alias("articles")))
    both = _answers(rows, one).unionByName(_answers(rows.where("n % 2 = 1"), two))
    return _told(providers.regional(both, most=1))


def web_page_results(spark: SparkSession, d: str) -> DataFrame:
    """Result pages in two layouts, the addresses behind a redirect."""
    plain = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N} ]", "")
    rows = _known(spark, d).where("url like 'http%'")
    href = F.concat(F.lit("//engine.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    block = F.concat(F.lit("<div><h2 class='result__title'><a href='"), href, F.lit("'>A "), plain("title"), F.lit("</a></h2><a class='result__snippet'>S "), plain("text"), F.lit("</a></div>"))
    line = F.concat(F.lit("<table><tr><td><a class='result-link' href='"), href, F.lit("'>A "), plain("title"), F.lit("</a></td></tr><tr><td class='result-snippet'>S "), plain("text"), F.lit("</td></tr></table>"))
    found = providers.web_results(_answers(rows, F.when(F.pmod("n", F.lit(2)) == 0, block).otherwise(line)))
    squeezed = lambda c: F.trim(F.regexp_replace(c, "[\\s\\p{Z}]+", " "))
    return _told(found.withColumn("title", squeezed("title")).withColumn("snippet", F.length("snippet").cast("string")))


def image_archive_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d)
    value = lambda c, n: F.struct(c.alias("value")).alias(n)
    info = F.struct("url", F.lit(640).alias("width"), F.lit(480).alias("height"), F.struct(value(F.concat(F.lit("<b>"), F.regexp_replace("title", "[<>]", ""), F.lit("</b>")), "ImageDescription"), value(F.when(F.pmod("n", F.lit(2)) == 0, "CC0"), "LicenseShortName")).alias("extmetadata"))
    page = F.struct(F.concat(F.lit("File:a_"), "id").alias("title"), F.array(info).alias("imageinfo"))
    return providers.image_answers(_answers(rows, F.to_json(F.struct(F.struct(F.create_map(F.col("id"), page).alias("pages")).alias("query"))))).withColumn("caption", F.md5("caption"))


def discovery_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d)
    general = _answers(rows, F.to_json(F.struct(F.array(F.struct("url", "title", F.col("text").alias("snippet"))).alias("results"))))
    code = _answers(rows.where("n % 3 = 0"), F.to_json(F.struct(F.array(F.struct(F.col("url").alias("html_url"), F.col("title").alias("full_name"))).alias("items"))))
    return providers.discover({"github": code, "general": general, "pubmed": general}, opt_in=("pubmed",))[1]


def diverse_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Documents' addresses before those of hits."""
    docs = table(spark, d, "documents").select("url", F.col("doc_id").alias("pos"))
    found = hits(spark, d).select("url", F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("bigint").alias("pos"))
    return providers.merged_seeds(docs, found).select("url", "origin", "pos")


def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    """No preferred addresses and no found ones: the fallback."""
    docs = table(spark, d, "documents").select("url", F.col("doc_id").alias("pos")).where("url is null")
    return providers.pool(docs, docs, "https://fallback.example/").select("url", "origin")


def open_access_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Documents by an address with a DOI, or by title, against chunks' addresses as known landing pages."""
    pages = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("https://doi.org/10.1234/x"), "doc_id")).otherwise(F.col("url")).alias("url"), F.split("text", "\n")[0].alias("title"))
    ids = table(spark, d, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("10.1234/X"), "doc_id").alias("doi"), F.lit("").alias("pdf_url"), F.concat(F.lit("https://land.example/"), "doc_id").alias("landing_url"))
    names = table(spark, d, "rag_chunks").select("title", F.col("source_url").alias("pdf_url"), F.lit(None).cast("string").alias("landing_url"))
    return providers.open_access(pages, ids, names).select("doc_id", "rescue_url")


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import markup

    safe = F.regexp_replace("url", "[&<>]", "_")
    xml = F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> "), F.lit(""), safe, F.lit("</loc></url><url><loc>"), safe, F.lit("</loc></url></urlset>"))
    return markup.sitemap_urls(table(spark, d, "documents").where("url is not null").select(xml.alias("xml"))).groupBy("url").agg(F.count("*").alias("n"))


def pdf_heads(spark: SparkSession, d: str) -> DataFrame:
    """Pages made into files of which every third has the mark of a PDF, some too late."""
    filler = F.when(F.pmod("artifact_id", F.lit(2)) == 0, F.lit("")).otherwise(F.repeat(F.lit("x"), F.lit(1100)))
    content = F.encode(F.concat(filler, F.when(F.pmod("artifact_id", F.lit(3)) == 0, "%PDF-1.7").otherwise("text")), "UTF-8")
    rows = table(spark, d, "captured_artifacts").select("artifact_id", content.alias("c")).distinct()
    return rows.select("artifact_id", acquisition.is_pdf(F.col("c")).alias("pdf"), media.magic_kind(F.col("c")).alias("kind"))


def pdf_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents' letters and digits put into PDF files of one page and read back."""
    plain = F.regexp_replace("text", "[^A-Za-z0-9 ]", "")
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << >> stream\nBT ("
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.concat(F.lit(head), plain, F.lit(") Tj ET\nendstream endobj\n")), "UTF-8").alias("content"))
    return pdf.pdf_texts(rows).select("id", F.md5("text").alias("text"))


# --- sinks --------------------------------------------------------------------------------------


def stored_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents written twice to a content store and read back by their hashes."""
    rows = table(spark, d, "captured_artifacts").select(F.col("raw_content").alias("content"))
    path = _folder(spark)
    sinks.store_contents(rows.limit(0).unionByName(rows), path)
    sinks.store_contents(rows, path)
    back = sinks.read_contents(spark, path, rows.where("content is not null").select(F.sha2("content", 256).alias("content_hash")))
    return back.select("content_hash", F.length("content").alias("bytes"), (F.sha2("content", 256) == F.col("content_hash")).alias("whole"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Scores of hits brought up to date by later deliveries; the hits of one kind of source deleted."""
    rows = table(spark, d, "retrieval_hits").select("id", F.unix_micros("retrieved_at").alias("at"), "source_type").distinct()
    first = rows.groupBy("id").agg(F.min("at").alias("at")).withColumn("v", F.lit("old"))
    late = rows.groupBy("id").agg(F.max("at").alias("at")).where("at is not null").withColumn("v", F.lit("new"))
    gone = rows.where("source_type = 'WIKI'").select("id")
    return sinks.delete_documents(sinks.upsert(first, late, "id", "at"), gone, "id")


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = text_queries._graph(spark, d)
    return sinks.manifest(table(spark, d, "documents"), table(spark, d, "rag_chunks"), nodes, edges, table(spark, d, "content_filter").where("rejection_reason <> ''"))


def rejection_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rejections written as JSON lines and read back with a declared schema."""
    path = _folder(spark)
    sinks.write_json(table(spark, d, "content_filter").where("rejection_reason <> ''").select("artifact_id", "rejection_reason", "link_density"), path)
    back = providers.json_lines(spark, path, "artifact_id bigint, rejection_reason string, link_density double")
    return back.groupBy("rejection_reason").agg(F.count("*").alias("n"), F.round(F.sum("link_density"), 6).alias("density"))


def context_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages written as a text file, their heads read back."""
    path = _folder(spark)
    sinks.context_text(table(spark, d, "rag_chunks").select("title", "heading_path", "text", "source_url")).write.text(path)
    return spark.read.text(path).where("value like 'Source: %'").groupBy(F.substring("value", 9, 10_000).alias("source_url")).agg(F.count("*").alias("n"))


def linked_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("url is not null and text is not null and text <> ''").select(F.col("doc_id").alias("n"), "url", F.lit("A title").alias("title"), F.col("text").alias("markdown"))
    return sinks.notes(rows, "q", "2025-01-02").select("name", F.md5("content").alias("content"))


def graph_corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.graph_corpus(*text_queries._graph(spark, d)).write.text(path)
    rows = spark.read.text(path).select(F.from_json("value", "record string, kind string, relation string").alias("j")).select("j.*")
    return rows.groupBy("record", F.coalesce("kind", "relation").alias("kind")).agg(F.count("*").alias("n"))


def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table of documents in three versions, each made from the one before."""
    steps = [
        lambda _: table(spark, d, "documents").select("doc_id", "source"),
        lambda t: t.withColumn("even", F.col("doc_id") % 2 == 0),
        lambda t: t.groupBy("source").agg(F.count("*").alias("n"), F.count_if("even").alias("even")),
    ]
    return sinks.migrate(spark, _folder(spark), steps)


def queue_capacity(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).select("seq")
    return sinks.push(rows.where("seq % 7 = 0"), rows.where("seq % 7 <> 0"), 700)


def sealed_archive(spark: SparkSession, d: str) -> DataFrame:
    """Two archives of one export are the same, byte by byte (written where the driver is)."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # an archive is one file on the driver
        for r in table(spark, d, "subjects").collect():  # eight rows
            with open(f"{folder}/{r.subject}.md", "w", encoding="utf-8") as f:
                f.write(f"# {r.title}\n\n{r.scope}\n")
        with tempfile.TemporaryDirectory() as out:
            same = sinks.deterministic_zip(folder, f"{out}/a.zip") == sinks.deterministic_zip(folder, f"{out}/b.zip")
    return spark.createDataFrame([(same,)], "same boolean")


# --- predicates and controls --------------------------------------------------------------------


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of chunks under rules that shut a host's first folder but for one letter."""
    rows = table(spark, d, "rag_chunks").select(U.host(F.col("source_url")).alias("host"), U.path(F.col("source_url")).alias("path")).where("host is not null").distinct()
    shut = rows.select("host", F.regexp_extract("path", "^(/[^/]*)", 1).alias("prefix"), F.lit(False).alias("allow")).where("prefix <> ''").distinct()
    open_ = rows.select("host", F.regexp_extract("path", "^(/[^/]*/[a-m])", 1).alias("prefix"), F.lit(True).alias("allow")).where("prefix <> ''").distinct()
    return media.robots_allowed(rows, shut.unionByName(open_))


def image_choice(spark: SparkSession, d: str) -> DataFrame:
    """Hits as pictures: their titles as captions against their queries, sizes from their lengths."""
    asked = table(spark, d, "search_queries").groupBy("query_id").agg(F.min("query").alias("query"))
    rows = _known(spark, d).join(asked, "query_id").select("query_id", "query", "url", F.col("n").alias("position"), F.col("title").alias("caption"), F.lit("").alias("alt"), F.lit("en.wikipedia.org").alias("source_domain"), (F.pmod("n", F.lit(2)) == 0).alias("primary"), (F.pmod("n", F.lit(5)) * 200).cast("int").alias("width"), F.lit(400).alias("height"))
    return media.ranked_images(rows, 5).select("query_id", "url", "relevance", "place")


def media_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = _known(spark, d).select("id", media.accepted(F.col("url"), (F.pmod("n", F.lit(5)) * 80).cast("int"), F.lit(200), F.col("score")).alias("accepted"))
    return rows.groupBy("accepted").agg(F.count("*").alias("n"))


def backend_eligibility(spark: SparkSession, d: str) -> DataFrame:
    level = lambda c: F.element_at(F.array(F.lit("none"), F.lit("partial"), F.lit("full")), (F.pmod(c, F.lit(3)) + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("js"), level("doc_id"), F.lit("cookies"), level(F.floor(F.col("doc_id") / 3))).alias("have"))
    need = F.create_map(F.lit("js"), F.lit("partial"), F.lit("cookies"), F.lit("full"))
    return rows.select("doc_id", classify.satisfies(F.col("have"), need).alias("eligible"))


def benchmark_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.domain_stats(_calls(spark, d)).select("domain", F.col("success_rate").alias("direct_rate"), (F.col("blocks") / F.col("attempts")).alias("block_rate"), F.when(F.col("attempts") > 9, "SUFFICIENT_EVIDENCE").otherwise("INSUFFICIENT").alias("status"))
    return metrics.quality_gate(rows).select("domain", "gate", F.array_join("failures", ",").alias("failures"))


def authority_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return _known(spark, d).select("id", ranking.authority_score(F.coalesce("score", F.lit(0.5)), n % 2 == 0, n % 3 == 0, n % 5 == 0).alias("authority"))


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("seq", acquisition.backoff(F.pmod("seq", F.lit(9)), F.lit(0.5) + F.pmod("seq", F.lit(4)) / 8).alias("wait"))


def canonical_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose head names the artifact as canonical, for every third one."""
    head = F.when(F.pmod("artifact_id", F.lit(3)) == 0, F.concat(F.lit("<LINK href='https://c.example/"), "artifact_id", F.lit("' rel=\"canonical\">"))).otherwise("")
    rows = table(spark, d, "captured_artifacts").select("artifact_id", F.concat(F.lit("<head><link rel='icon' href='i'>"), head, F.decode(F.coalesce("raw_content", F.lit(b"")), "ISO-8859-1")).alias("html")).distinct()
    return rows.select("artifact_id", acquisition.canonical_link(F.col("html")).alias("canonical")).distinct()


def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("url is not null").select("doc_id", F.concat(F.lit("//e.example/l/?kh=1&uddg="), F.url_encode("url"), F.lit("&r=2")).alias("u"))
    return rows.select("doc_id", U.unwrapped(F.col("u")).alias("url"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """DOIs: as part of an address, implied by a publisher's address, none."""
    doc = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see https://doi.org/10.1000/ab."), doc, F.lit(")."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://www.nature.com/articles/s"), doc, F.lit("?x=1"))).otherwise("https://none.example/")
    return table(spark, d, "documents").select("doc_id", U.doi(url).alias("doi"))


def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d)
    return rows.select("seq", acquisition.idempotency_key(F.concat(F.lit("e"), "domain"), F.col("provider"), F.pmod("seq", F.lit(3)), F.struct("seq", "provider")).alias("key"))


def normalised_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(T.compatible(F.col("text"))).alias("content_hash"))


def wide_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pseudo_vectors(table(spark, d, "documents"), "doc_id", wide=True)


def tile_directions(spark: SparkSession, d: str) -> DataFrame:
    """Screenshots' directions: length one, and as many as there are contents."""
    rows = retrieval.tile_vectors(table(spark, d, "captured_artifacts").select(F.col("artifact_id").alias("id"), F.col("raw_content").alias("content")))
    size = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return rows.where("vector is not null").groupBy(size.alias("size")).agg(F.count_distinct(F.hash("vector")).alias("directions"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rag_chunks").select("source_url", acquisition.in_scope(F.col("source_url"), "Review", False).alias("near"), acquisition.in_scope(F.col("source_url"), "Review", True).alias("any"))
    return rows.groupBy("near", "any").agg(F.count("*").alias("n"))


def link_choice(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of a query to follow, some of them in navigation or footer."""
    n = F.col("n")
    rows = _known(spark, d).select(F.col("query_id").alias("page"), "url", F.round("score", 4).alias("score"), (n % 5 == 0).alias("is_navigation"), (n % 7 == 0).alias("is_footer"))
    return acquisition.expansion_links(rows, 3)


def latency_samples(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_sample(_calls(spark, d).select(F.col("domain").alias("host"), "seq", "latency"), 5)


def activity_ratios(spark: SparkSession, d: str) -> DataFrame:
    return metrics.activity_ratios(_calls(spark, d).select(F.col("provider").alias("activity"), F.col("success").alias("ok"), F.col("domain").alias("key"), F.col("bytes").alias("weight")))


def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).where("error").select(F.col("domain").alias("run"), F.col("strategy").alias("provider"), F.when(F.col("blocked"), "BLOCKED").when(F.col("timeout"), "TIMEOUT").alias("reason"))
    return metrics.reason_histogram(rows)


def trace_of(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).select(F.col("domain").alias("entity_id"), F.col("provider").alias("event_type"), "seq")
    return metrics.trace_events(rows, "7", "click")


def late_subscriber(spark: SparkSession, d: str) -> DataFrame:
    return metrics.event_history(_calls(spark, d).select(F.col("domain").alias("job"), "seq"), 4)


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_pages(_calls(spark, d).select(F.col("domain").alias("run"), "seq", F.col("success").alias("ok")), 3).select("run", "seq", "place")


def full_budget(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    rows = _calls(spark, d).select(
        F.col("domain").alias("job"), "seq", "bytes", F.pmod(seq, F.lit(5)).alias("depth"), F.pmod(seq, F.lit(7)).cast("double").alias("browser_seconds"), (F.pmod(seq, F.lit(4)) == 0).alias("visual"),
        F.pmod(seq, F.lit(30)).alias("llm_tokens"), seq.cast("double").alias("ts"),
    )
    return metrics.admit(rows, pages=40, bytes_=1500, depth=3, browser_seconds=60.0, visual_pages=6, llm_tokens=200, deadline=1e12)


def graph_answers(spark: SparkSession, d: str) -> DataFrame:
    """Text packs of five queries over the document nodes."""
    nodes = text_queries._graph(spark, d)[0].where("kind = 'DOCUMENT'")
    asked = spark.createDataFrame(list(enumerate(S.QUERIES)), "query_id int, query string")
    targets = spark.createDataFrame([(0, "doc:1"), (1, "doc:none")], "query_id int, node_id string")
    return graphs.graph_context(graphs.graph_paths(nodes, asked, targets), 20).select("query_id", "candidates", "status", "digest")


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their terms replaced, one after the other."""
    rows = table(spark, d, "search_queries").select("query_id", "query").distinct()
    return rows.select("query_id", "query", research.translated(F.col("query"), [("and", "und"), ("of", "von"), ("in", "im")]).alias("translated"))


def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """The requests that each search query leads to: services in the order of their use, per goal."""
    rows = table(spark, d, "search_queries").where("query is not null").select("query_id", "query").distinct()

    def plan(parts):
        for part in parts:
            out = []
            for key, text in zip(part["query_id"], part["query"]):
                targets = research.goals(text)
                asked = research.variants(text, targets)
                for goal in targets:
                    out += [(key, goal.goal_id, place, *r) for place, r in enumerate(research.plan_requests(text, goal, asked))]
            yield pd.DataFrame(out, columns=["query_id", "goal_id", "place", "service", "query", "results", "language"])

    return rows.mapInPandas(plan, "query_id string, goal_id string, place int, service string, query string, results int, language string")


def query_goals(spark: SparkSession, d: str) -> DataFrame:
    """How many goals a query is taken apart into, of texts made into comparisons and disputes."""
    n = F.length("query")
    text = F.concat(F.col("query"), F.when(n % 3 == 0, " vs other things").otherwise(""), F.when(n % 2 == 0, " side effect").otherwise(""))
    rows = table(spark, d, "search_queries").where("query is not null").select("query_id", text.alias("query")).distinct()

    def count(parts):
        for part in parts:
            yield pd.DataFrame({"query_id": part["query_id"], "goals": [len(research.goals(q)) for q in part["query"]]})

    return rows.mapInPandas(count, "query_id string, goals int")


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_queries").select("query_id", "query").distinct()
    return rows.select("query_id", F.array_join(V.query_tokens(F.col("query")), " ").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        crossref_results, semantic_scholar_results, arxiv_results, europe_pmc_results, pubmed_results, wikipedia_results, github_results, regional_results, web_page_results, image_archive_results, discovery_report, diverse_seeds, seed_pool,
        open_access_rescue, sitemap_pages, pdf_heads, pdf_documents, stored_contents, vector_upsert, manifest_counts, rejection_lines, context_passages, linked_notes, graph_corpus_lines, table_versions, queue_capacity, sealed_archive, robots_rules, image_choice,
        media_accepted, backend_eligibility, benchmark_gate, authority_scores, retry_waits, canonical_links, redirect_targets, identifiers, idempotency_keys, normalised_hashes, wide_vectors, tile_directions, scope_filter, link_choice, latency_samples,
        activity_ratios, rejection_histogram, trace_of, late_subscriber, early_stop, full_budget, graph_answers, query_terms, query_plans, query_goals, query_tokens,
    )
}

_K = f"{_HITS}, k as (select *, ('0x' || substr(md5(id), 1, 6))::bigint as n from h where title is not null and text is not null and url is not null)"
_LETTERS = "regexp_replace(%s, '[^\\p{L}\\p{N} ]', '', 'g')"


def _rows(url: str, title: str, snippet: str, kind: str, year: str, prior: str, source: str = "k", rank: str = "1") -> str:
    return f"select id as query_id, {rank} as provider_rank, {url} as url, md5({title}) as title, md5({snippet}) as snippet, {kind} as source_type, {year} as published_at, {prior}::double as authority_prior from {source}"


_ROLE = "case when contains(lower(title), 'review') then 'SYSTEMATIC_REVIEW' when n % 3 = 0 then 'BOOK_CHAPTER' else 'PRIMARY_RESEARCH' end"
_YEAR = "(2000 + n % 20)::varchar"
_PLACE = f"case when coalesce(source_type, '') <> '' then '[' || source_type || ', ' || {_YEAR} || '] ' else '' end"
_JUST = "'PRIMARY_RESEARCH'"

_TITLE = S.sanitised("string_split(text, chr(10))[1]")
_QUERY_ROWS = ", ".join(f"({i}, '{q}')" for i, q in enumerate(S.QUERIES))

ORACLE = {
    "image_choice": f"""with {_K}, q as (select query_id, min(query) as query from search_queries group by 1),
      w as (select k.query_id, url, n, {S.tokens("query")} as asked, lower(title) || '  ' || lower(regexp_extract(url, '([^/]*)$', 1)) as t, title from k join q using (query_id) where url <> ''),
      o as (select *, {S.tokens("t")} as words, row_number() over (partition by query_id, url order by n) as r from w),
      s as (select query_id, url, t, n, len(asked) as a, len(list_filter(asked, lambda x: list_contains(words, x) or (length(x) >= 4 and len(list_filter(words, lambda y: length(y) >= 4 and (starts_with(x, y) or starts_with(y, x)))) > 0))) / greatest(len(asked), 1) as share, n % 5 * 200 as width from o where r = 1),
      v as (select query_id, url, a, t, width, round(greatest(0.05::double, least(1::double, case when n % 2 = 0 then 0.35::double else 0.30::double end + share * 0.45::double + 0.15::double + case when width > 0 then (case when width >= 400 then 0.15::double else 0 end) + (case when width / 400.0 between 0.4 and 2.5 then 0.05::double else -0.1::double end) else 0 end)), 3) as relevance from s)
      select query_id, url, relevance, place from (select *, row_number() over (partition by query_id order by relevance desc, url desc) - 1 as place from v where not {S.any_of("t", media.EXCLUDED_WORDS)} and width >= 160 and (a = 0 or relevance >= 0.55)) where place < 5""",
    "graph_answers": f"""with n as (select 'doc:' || doc_id as node_id, case when {_TITLE} <> '' then {_TITLE} else 'Document ' || coalesce(url, '') end as text from documents where text is not null),
      q as (select query_id, string_split(query, ' ') as words from (values {_QUERY_ROWS}) v(query_id, query)),
      m as (select query_id, node_id, text from q join n on len(list_filter(words, lambda w: contains(lower(text), w))) > 0 union select 0, node_id, text from n where node_id = 'doc:1'),
      p as (select *, row_number() over (partition by query_id order by node_id) - 1 as path from m)
      select query_id, count(*) as candidates, 'complete' as status, sha256('{graphs.PACK_HEAD}' || query_id || '{graphs.PACK_PATHS}' || chr(10) || string_agg('path=path_' || path || '_' || node_id || ' polarity=1 state=accepted' || chr(10) || '  external_id="' || node_id || '"' || chr(10) || '    SOURCE_DATA="' || text || '"', chr(10) order by path) filter (path < 20) || chr(10) || '{graphs.PACK_END}') as digest from p group by query_id""",
    "crossref_results": f"with {_K} " + _rows("'https://doi.org/10.5/' || id", "title", _PLACE + " || substr(regexp_replace(regexp_replace(text, '[<>]', '', 'g'), '^ +| +$', '', 'g'), 1, 350)", _ROLE, _YEAR, "case when n % 100 > 50 then 0.98 else 0.94 end"),
    "semantic_scholar_results": f"with {_K} " + _rows("case when n % 2 = 0 then 'https://doi.org/10.6/' || id else 'https://www.semanticscholar.org/paper/' || id end", "title", _PLACE + " || substr(text, 1, 350)", "case when n % 4 = 0 then 'SYSTEMATIC_REVIEW' else 'PRIMARY_RESEARCH' end", _YEAR, "case when n % 150 > 100 or n % 13 > 10 then 0.98 when n % 150 > 20 then 0.95 else 0.92 end"),
    "arxiv_results": f"with {_K} " + _rows("'http://arxiv.org/abs/' || id", f"'A ' || regexp_replace({_LETTERS % 'title'}, ' +', ' ', 'g') || case when {_LETTERS % 'title'} like '% ' then '' else ' ' end || '. z'", f"substr(regexp_replace(regexp_replace('S ' || {_LETTERS % 'text'}, ' +', ' ', 'g'), ' $', ''), 1, 300)", _JUST, "'2020-01-02'", "0.90"),
    "europe_pmc_results": f"with {_K} " + _rows("'https://' || case n % 4 when 0 then 'europepmc.org/article/PMC/PMC' || id when 1 then 'europepmc.org/article/MED/' || id else 'doi.org/10.7/' || id end", "title", "substr(text, 1, 350)", _JUST, "'1999'", "0.95", "k where n % 4 < 3"),
    "pubmed_results": f"with {_K}, p as (select id, unnest([id, query_id]) as x, unnest([1, 2]) as r from k) " + _rows("'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || x || '/'", "'NCBI PMC Article ' || x", "''", _JUST, "null::varchar", "0.95", "p where x is not null", "r"),
    "wikipedia_results": f"with {_K}, p as (select id, url as u, title as t, text as s, 1 as r from k union all select id, url || '#2', coalesce(source_type, ''), '', 2 from k) " + _rows("u", "t", "s", "'WIKI'", "null::varchar", "0.75", "p where u <> ''", "r"),
    "github_results": f"with {_K} " + _rows("url", "'GitHub: ' || title", "case when n % 2 = 0 then text else '' end", "'SOURCE_CODE'", "'2021-05-06'", "0.90", "k where url <> ''"),
    "regional_results": f"""with {_K}, p as (select id, query_id, case when n % 2 = 0 then 'https://doi.org/10.8/' || id else url end as u, title as t, '[HAL EU Repository] ' || substr(text, 1, 300) as s, '2001' as y, 0.91 as a from k where n % 2 = 0 or url <> ''
      union all select id, query_id, 'https://cyberleninka.ru/article/' || id, case when title <> '' then title else 'Научная статья' end, '[J, 2002] ' || substr(text, 1, 300), '2002', 0.90 from k where n % 2 = 1 and url = '') """ + _rows("u", "t", "s", _JUST, "y", "a", "p"),
    "web_page_results": f"with {_K} " + _rows("url", f"regexp_replace(regexp_replace('A ' || {_LETTERS % 'title'}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' $', '')", f"least(300, length(regexp_replace(regexp_replace('S ' || {_LETTERS % 'text'}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' $', '')))::varchar", "'OFFICIAL_DOC'", "null::varchar", "0.70", "k where url like 'http%' and not contains(url, 'duckduckgo.com')"),
    "image_archive_results": f"""with {_K} select id as query_id, url, md5(substr(regexp_replace(regexp_replace(title, '[<>]', '', 'g'), '^ +| +$', '', 'g'), 1, 200)) as caption, 'a ' || replace(id, '_', ' ') as alt, 640 as width, 480 as height, 'commons.wikimedia.org' as source_domain,
      case when n % 2 = 0 then 'CC0' else 'UNKNOWN_LICENSE' end as license, 'UNKNOWN_AUTHOR' as author from k where url <> ''""",
    "discovery_report": f"""with {_K}, c as (select url, id, query_id, 0 as place, 'github' as provider from k where n % 3 = 0 and url <> '' union all select url, id, query_id, 1, 'general' from k where url like 'http%'),
      f as (select *, row_number() over (partition by url order by id, place) as r from c) select provider, count(*) as found, count(*) filter (r = 1) as kept from f group by provider""",
    "diverse_seeds": f"""with {_HITS}, b as (select url, 0 as origin, doc_id as pos from documents where url is not null union all select url, 1, ('0x' || substr(md5(id), 1, 12))::bigint from h where url is not null)
      select url, origin, pos from (select *, row_number() over (partition by url order by origin, pos) as r from b) where r = 1""",
    "seed_pool": "select 'https://fallback.example/' as url, 2 as origin",
    "open_access_rescue": """with n as (select lower(title) as t, min(case when source_url <> '' then source_url end) as u from rag_chunks where title is not null group by 1)
      select doc_id, coalesce(case when doc_id % 4 = 0 then 'https://land.example/' || doc_id end, u) as rescue_url from documents left join n on lower(string_split(text, chr(10))[1]) = t""",
    "sitemap_pages": "select regexp_replace(url, '[&<>]', '_', 'g') as url, 2 * count(*) as n from documents where starts_with(url, 'http') group by 1",
    "pdf_heads": "select distinct artifact_id, artifact_id % 3 = 0 and artifact_id % 2 = 0 as pdf, case when artifact_id % 3 = 0 and artifact_id % 2 = 0 then 'pdf' end as kind from captured_artifacts",
    "pdf_documents": """with p as (select doc_id as id, regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') as t from documents) select id, md5(case when t <> '' then '## Page 1' || chr(10) || chr(10) || t else '' end) as text from p""",
    "stored_contents": "select distinct sha256(raw_content) as content_hash, octet_length(raw_content) as bytes, true as whole from captured_artifacts where raw_content is not null",
    "vector_upsert": "select id, coalesce(max(epoch_us(retrieved_at)), min(epoch_us(retrieved_at))) as at, case when max(retrieved_at) is null then 'old' else 'new' end as v from retrieval_hits where id not in (select id from retrieval_hits where source_type = 'WIKI' and id is not null) group by id",
    "manifest_counts": f"""with p as (select doc_id, unnest(string_split_regex({S.sanitised('text')}, '\\n[\\s\\x0B]*\\n')) as q from documents where text is not null), e as (select count(*) as n from p where {S.word_count('q')} >= 4)
      select (select count(*) from documents) as total_documents, (select count(*) from rag_chunks) as total_chunks, (select count(*) from documents where text is not null) + (select n from e) as total_nodes, (select n from e) as total_edges, (select count(*) from content_filter where rejection_reason <> '') as total_rejections""",
    "rejection_lines": "select rejection_reason, count(*) as n, round(sum(link_density), 6) as density from content_filter where rejection_reason <> '' group by 1",
    "context_passages": "select coalesce(source_url, '') as source_url, count(*) as n from rag_chunks where text is not null group by 1",
    "linked_notes": """select case when length(doc_id::varchar) < 2 then lpad(doc_id::varchar, 2, '0') else substr(doc_id::varchar, 1, 2) end || '_a-title' as name,
      md5('---' || chr(10) || 'title: "A title"' || chr(10) || 'source_url: ' || url || chr(10) || 'domain: ' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) || chr(10) || 'date_captured: 2025-01-02' || chr(10) || '---' || chr(10) || chr(10) || '# A title' || chr(10) || chr(10) || text || chr(10) || chr(10) || '- [[00_Index|Back to index: q]]') as content
      from documents where url is not null and text is not null and text <> ''""",
    "graph_corpus_lines": f"""with p as (select unnest(string_split_regex({S.sanitised('text')}, '\\n[\\s\\x0B]*\\n')) as q from documents where text is not null), e as (select starts_with({S.trimmed('q')}, '#') as head, count(*) as n from p where {S.word_count('q')} >= 4 group by 1)
      select 'node' as record, case when head then 'PROPOSITION' else 'EVIDENCE' end as kind, n from e union all select 'edge', case when head then 'derived_from' else 'evidence_for' end, n from e union all select 'node', 'DOCUMENT', count(*) from documents where text is not null""",
    "table_versions": "select source, count(*) as n, count(*) filter (doc_id % 2 = 0) as even from documents group by source",
    "queue_capacity": "select event_id as seq, row_number() over (order by event_id) <= greatest(0, 700 - (select count(*) from events where event_id % 7 = 0)) as pushed from events where event_id % 7 <> 0",
    "sealed_archive": "select true as same",
    "robots_rules": f"""with r as (select distinct {S.host('source_url')} as host, {S.path('source_url')} as path from rag_chunks)
      select host, path, case when regexp_matches(path, '^/[^/]*/[a-m]') then true when path like '/%' then false else true end as allowed from r where host is not null""",
    "media_accepted": f"""with {_K} select n % 5 * 80 >= 160 and score >= 0.55 and not {S.any_of('lower(url)', media.EXCLUDED_WORDS)} as accepted, count(*) as n from k group by 1""",
    "backend_eligibility": "select doc_id, doc_id % 3 >= 1 and (doc_id // 3) % 3 >= 2 as eligible from documents",
    "benchmark_gate": f"""with {_CALLS}, s as (select domain, round(count(*) filter (not error) / count(*), 2) as d, count(*) filter (blocked) / count(*) as b, count(*) as n from c group by domain)
      select domain, d >= 0.8 and b <= 0 and n > 9 as gate, array_to_string(list_filter([case when d < 0.8 then 'DIRECT_EVIDENCE_RATE' end, case when b > 0 then 'BLOCK_RATE' end, case when n <= 9 then 'STATUS' end], lambda x: x is not null), ',') as failures from s""",
    "authority_scores": f"""with {_K}, b as (select id, n, case when n % 3 = 0 or n % 5 = 0 then greatest(coalesce(score, 0.5), 0.92::double) else coalesce(score, 0.5) end as p from k) select id, round(case when n % 2 = 0 then least(1, p + 0.05::double) else p end, 3) as authority from b""",
    "retry_waits": "select event_id as seq, least(60, pow(2, event_id % 9)) * (0.5::double + (event_id % 4) / 8.0::double) as wait from events",
    "canonical_links": "select distinct artifact_id, case when artifact_id % 3 = 0 then 'https://c.example/' || artifact_id end as canonical from captured_artifacts",
    "redirect_targets": "select doc_id, url from documents where url is not null",
    "identifiers": "select doc_id, case doc_id % 3 when 0 then '10.1000/ab.' || doc_id when 1 then '10.1038/s' || doc_id end as doi from documents",
    "idempotency_keys": "select event_id as seq, 'e' || user_id || ':' || event_type || ':r' || event_id % 3 || ':' || substr(sha256('{\"seq\":' || event_id || ',\"provider\":\"' || event_type || '\"}'), 1, 16) as key from events",
    "wide_vectors": f"""with t as (select doc_id as id, unnest({S.words('lower(text)')}) as w from documents), c as (select id, cast(('0x' || md5(w))::uhugeint % 384 as int) as bucket, count(*) as n from t group by id, bucket)
        select id, bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) as value from c""",
    "tile_directions": "select 1.0::double as size, count(distinct raw_content) as directions from captured_artifacts where raw_content is not null",
    "scope_filter": "select coalesce(contains(lower(source_url), 'review'), false) as near, true as any, count(*) as n from rag_chunks group by 1",
    "latency_samples": f"with {_CALLS}, r as (select *, row_number() over (partition by domain order by seq desc) as k from c) select domain as host, count(*) as samples, round(avg(value), 6) as mean_latency from r where k <= 5 group by domain",
    "activity_ratios": f"with {_CALLS} select provider as activity, count(*) as items, round(avg(cast(not error as int)), 6) as success_ratio, round(count(distinct domain) / count(*), 6) as unique_ratio, round(avg(bytes), 6) as density from c group by provider",
    "rejection_histogram": f"""with {_CALLS}, r as (select domain as run, strategy as provider, case when blocked then 'BLOCKED' when timeout then 'TIMEOUT' end as reason from c where error)
      select run, 'provider' as kind, provider as value, count(*) as n from r group by all union all select run, 'reason', reason, count(*) from r where reason is not null group by all""",
    "trace_of": "select user_id::varchar as entity_id, event_type, event_id as seq from events where user_id = 7 and event_type = 'click'",
    "late_subscriber": "select user_id::varchar as job, event_id as seq, row_number() over (partition by user_id order by event_id) - 1 as place from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k <= 4",
    "early_stop": "select run, seq, place from (select user_id::varchar as run, event_id as seq, row_number() over (partition by user_id order by event_id) - 1 as place from events where event_type <> 'error') where place < 3",
    "query_goals": f"""with t as (select distinct query_id, query || case when length(query) % 3 = 0 then ' vs other things' else '' end || case when length(query) % 2 = 0 then ' side effect' else '' end as q from search_queries where query is not null)
      select query_id, 1 + case when ({S.any_of("lower(q)", research.COMPARED)}) and regexp_matches(' ' || q || ' ', '(?i)[^\\p{{L}}\\p{{N}}_](vs|versus|против|и)[^\\p{{L}}\\p{{N}}_]') then 2 else 0 end + case when {S.any_of("lower(q)", research.DISPUTE_CUES)} then 1 else 0 end
        + len(list_distinct(list_transform(regexp_extract_all(q, '(?i)(?:ГОСТ|ISO|RFC|IEEE)[\\s]*[\\d.-]+(?::\\d+)?'), lambda x: lower(x)))) as goals from t""",
    "query_terms": "select distinct query_id, query, replace(replace(replace(query, 'and', 'und'), 'of', 'von'), 'in', 'im') as translated from search_queries",
    "query_tokens": f"select distinct query_id, array_to_string(list_filter({S.tokens('query')}, lambda t: length(t) > 2), ' ') as tokens from search_queries",
    "full_budget": """with recursive r as (select user_id::varchar as job, event_id as seq, (event_id % 100)::bigint as bytes, event_id % 5 as depth, (event_id % 7)::double as sec, event_id % 4 = 0 as visual, (event_id % 30)::bigint as tok, row_number() over (partition by user_id order by event_id) as k from events),
      f as (select job, seq, k, reason, case when reason is null then 1 else 0 end::bigint as n, case when reason is null then bytes else 0 end::bigint as used, case when reason is null then sec else 0 end::double as sec, case when reason is null and visual then 1 else 0 end::bigint as vis, case when reason is null then tok else 0 end::bigint as tok
        from (select *, case when depth > 3 then 'DEPTH' when bytes > 1500 then 'BYTES' when sec > 60 then 'BROWSER' when tok > 200 then 'TOKENS' end as reason from r where k = 1)
        union all
        select job, seq, k, reason, n + case when reason is null then 1 else 0 end, used + case when reason is null then bytes else 0 end, s + case when reason is null then sec else 0 end, vis + case when reason is null and visual then 1 else 0 end, t + case when reason is null then tok else 0 end
        from (select r.*, f.n, f.used, f.sec as s, f.vis, f.tok as t, case when r.depth > 3 then 'DEPTH' when f.n + 1 > 40 then 'PAGES' when f.used + r.bytes > 1500 then 'BYTES' when r.sec > 0 and f.sec + r.sec > 60 then 'BROWSER' when r.visual and f.vis + 1 > 6 then 'VISUAL' when r.tok > 0 and f.tok + r.tok > 200 then 'TOKENS' end as reason
          from f join r on r.job = f.job and r.k = f.k + 1))
      select job, seq, reason is null as admitted, reason from f""",
}
