"""Saved answers of search services as candidate rows.

Fetching is outside the engine: an answer is a row (query_id, goal_id, body) with the service's JSON
or XML as text. Every reader gives the same columns, so answers of several services are united by
name and ranked together. A body that can't be parsed gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dedup import first_by
from tessera.operators.positions import grouped_positions

CANDIDATE = ["query_id", "goal_id", "provider", "provider_rank", "url", "title", "snippet", "source_type", "published_at", "authority_prior"]


def _rows(items: DataFrame, provider: str, url: Column, title: Column, snippet: Column, kind: Column, year: Column, prior: Column) -> DataFrame:
    out = items.select(
        "query_id", "goal_id", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("provider_rank"), url.alias("url"), title.alias("title"), snippet.alias("snippet"), kind.alias("source_type"),
        year.cast("string").alias("published_at"), prior.cast("double").alias("authority_prior"),
    )
    return out.where("url is not null and url <> ''")


def _items(answers: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = answers.select("query_id", "goal_id", F.from_json("body", schema).alias("j"))
    return parsed.select("query_id", "goal_id", F.posexplode(F.col(path)).alias("pos", "x"))


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _bracketed(place: Column, year: Column, text: Column) -> Column:
    return F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit("["), place, F.lit(", "), F.coalesce(year.cast("string"), F.lit("")), F.lit("] "), text)).otherwise(text)


def abstract_of(index: Column) -> Column:
    """A text from its inverted index (word -> positions)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def openalex(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "results array<struct<id:string,doi:string,title:string,abstract_inverted_index:map<string,array<int>>,publication_year:int,cited_by_count:int,type:string,open_access:struct<oa_url:string>,primary_location:struct<landing_page_url:string>>>", "j.results")
    x, cited = F.col("x"), F.coalesce(F.col("x.cited_by_count"), F.lit(0))
    title = F.coalesce(_first(x["title"]), F.lit("Scientific Work"))
    kind = F.lower(F.coalesce(_first(x["type"]), F.lit("article")))
    text = abstract_of(x["abstract_inverted_index"])
    snippet = F.when(F.coalesce(text, F.lit("")) != "", F.substring(text, 1, 350)).otherwise(F.concat(F.lit("Published in "), F.coalesce(x["publication_year"].cast("string"), F.lit("N/A")), F.lit(", Cited by "), cited.cast("string"), F.lit(" researchers.")))
    role = F.when(F.contains(kind, F.lit("review")) | F.contains(F.lower(title), F.lit("review")), "SYSTEMATIC_REVIEW").when(F.contains(kind, F.lit("dataset")), "DATASET").otherwise("PRIMARY_RESEARCH")
    prior = F.when(cited > 150, 0.99).when(cited > 30, 0.95).otherwise(0.93)
    return _rows(rows, "openalex", _first(x["doi"], x["open_access"]["oa_url"], x["primary_location"]["landing_page_url"], x["id"]), title, snippet, role, x["publication_year"], prior)


def crossref(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,`is-referenced-by-count`:int,`container-title`:array<string>,type:string,published:struct<`date-parts`:array<array<int>>>>>>", "j.message.items")
    x, cited = F.col("x"), F.coalesce(F.col("x.is-referenced-by-count"), F.lit(0))
    title = F.coalesce(F.try_element_at(x["title"], F.lit(1)), F.lit("Scientific Publication"))
    kind = F.lower(F.coalesce(x["type"], F.lit("journal-article")))
    year = F.try_element_at(F.try_element_at(x["published"]["date-parts"], F.lit(1)), F.lit(1))
    text = F.substring(F.trim(F.regexp_replace(F.coalesce(x["abstract"], F.lit("")), "<[^>]+>", "")), 1, 350)
    role = F.when(F.contains(kind, F.lit("review")) | F.contains(F.lower(title), F.lit("review")), "SYSTEMATIC_REVIEW").when(F.contains(kind, F.lit("book")) | F.contains(kind, F.lit("chapter")), "BOOK_CHAPTER").otherwise("PRIMARY_RESEARCH")
    return _rows(rows, "crossref", F.when(x["DOI"] != "", F.concat(F.lit("https://doi.org/"), x["DOI"])), title, _bracketed(F.try_element_at(x["container-title"], F.lit(1)), year, text), role, year, F.when(cited > 50, 0.98).otherwise(0.94))


def semantic_scholar(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "data array<struct<paperId:string,title:string,abstract:string,year:int,citationCount:int,influentialCitationCount:int,venue:string,publicationTypes:array<string>,openAccessPdf:struct<url:string>,externalIds:map<string,string>>>", "j.data")
    x = F.col("x")
    cited, strong = F.coalesce(x["citationCount"], F.lit(0)), F.coalesce(x["influentialCitationCount"], F.lit(0))
    url = _first(F.concat(F.lit("https://doi.org/"), F.try_element_at(x["externalIds"], F.lit("DOI"))), F.concat(F.lit("https://www.semanticscholar.org/paper/"), _first(x["paperId"])), x["openAccessPdf"]["url"])
    review = F.coalesce(F.exists(x["publicationTypes"], lambda t: F.contains(t, F.lit("Review")) | F.contains(t, F.lit("MetaAnalysis"))), F.lit(False))
    prior = F.when((cited > 100) | (strong > 10), 0.98).when(cited > 20, 0.95).otherwise(0.92)
    return _rows(rows, "semantic_scholar", url, F.coalesce(x["title"], F.lit("")), _bracketed(x["venue"], x["year"], F.substring(F.coalesce(x["abstract"], F.lit("")), 1, 350)), F.when(review, "SYSTEMATIC_REVIEW").otherwise("PRIMARY_RESEARCH"), x["year"], prior)


def arxiv(answers: DataFrame) -> DataFrame:
    """Atom entries; white space of titles and summaries squeezed."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    each = lambda tag: F.xpath("body", F.lit(f"//*[local-name()='entry']/*[local-name()='{tag}']/text()"))
    zipped = F.arrays_zip(each("id").alias("id"), each("title").alias("title"), each("summary").alias("summary"), each("published").alias("published"))
    rows = answers.where("body like '%<%'").select("query_id", "goal_id", F.posexplode(zipped).alias("pos", "x"))
    x = F.col("x")
    return _rows(rows, "arxiv", F.trim(x["id"]), squeezed(x["title"]), F.substring(squeezed(x["summary"]), 1, 300), F.lit("PRIMARY_RESEARCH"), F.trim(x["published"]), F.lit(0.90))


def europe_pmc(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "resultList struct<result:array<struct<pmcid:string,pmid:string,doi:string,title:string,abstractText:string,pubYear:string>>>", "j.resultList.result")
    x, base = F.col("x"), "https://europepmc.org/article/"
    url = _first(F.concat(F.lit(base + "PMC/"), _first(x["pmcid"])), F.concat(F.lit(base + "MED/"), _first(x["pmid"])), F.concat(F.lit("https://doi.org/"), _first(x["doi"])))
    return _rows(rows, "europe_pmc", url, F.coalesce(x["title"], F.lit("")), F.substring(F.coalesce(x["abstractText"], F.lit("")), 1, 350), F.lit("PRIMARY_RESEARCH"), x["pubYear"], F.lit(0.95))


def pubmed(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "esearchresult struct<idlist:array<string>>", "j.esearchresult.idlist")
    x = F.col("x")
    return _rows(rows, "pubmed", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), x, F.lit("/")), F.concat(F.lit("NCBI PMC Article "), x), F.lit(""), F.lit("PRIMARY_RESEARCH"), F.lit(None), F.lit(0.95))


def wikipedia(answers: DataFrame) -> DataFrame:
    """The positional answer [query, titles, snippets, urls]; short arrays are padded with empty strings."""
    part = lambda i: F.from_json(F.get_json_object("body", f"$[{i}]"), "array<string>")
    rows = answers.select("query_id", "goal_id", F.posexplode(F.arrays_zip(part(1).alias("t"), part(2).alias("s"), part(3).alias("u"))).alias("pos", "x"))
    x, empty = F.col("x"), F.lit("")
    return _rows(rows, "wikipedia", x["u"], F.coalesce(x["t"], empty), F.coalesce(x["s"], empty), F.lit("WIKI"), F.lit(None), F.lit(0.75))


def github(answers: DataFrame) -> DataFrame:
    rows = _items(answers, "items array<struct<html_url:string,full_name:string,description:string,updated_at:string>>", "j.items")
    x = F.col("x")
    return _rows(rows, "github", x["html_url"], F.concat(F.lit("GitHub: "), F.coalesce(x["full_name"], F.lit(""))), F.coalesce(x["description"], F.lit("")), F.lit("SOURCE_CODE"), x["updated_at"], F.lit(0.90))


#: Address parts (fixed values) that mark a general result as research.
RESEARCH_PARTS = ("arxiv.org", "doi.org", "ncbi.nlm.nih.gov", "nature.com", "sciencedirect.com", "springer.com", "ieee.org", "acm.org")


def general(answers: DataFrame, most: int = 20) -> DataFrame:
    """Web results (url, title, snippet): http addresses only; the limit counts after the filter, ranks before it."""
    rows = _items(answers, "results array<struct<url:string,title:string,snippet:string>>", "j.results").where("x.url like 'http%'")
    kept = rows.groupBy("query_id", "goal_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "x"))), 1, most).alias("k")).select("query_id", "goal_id", F.inline("k"))  # one answer's results
    x = F.col("x")
    role = F.when(x["url"].rlike("|".join(p.replace(".", "\\.") for p in RESEARCH_PARTS)), "PRIMARY_RESEARCH").otherwise("OFFICIAL_DOC")
    return _rows(kept, "general", x["url"], F.coalesce(x["title"], F.lit("")), F.substring(F.coalesce(x["snippet"], F.lit("")), 1, 400), role, F.lit(None), F.lit(0.85))


def regional(answers: DataFrame, most: int = 20) -> DataFrame:
    """Two regional academic hubs; their answers come as rows of their own. The limit keeps the first hub first."""
    x, empty = F.col("x"), F.lit("")
    one = _items(answers, "response struct<docs:array<struct<uri_s:string,title_s:array<string>,abstract_s:array<string>,producedDateY_i:int,doiId_s:string>>>", "j.response.docs")
    title = F.coalesce(F.try_element_at(x["title_s"], F.lit(1)), F.lit("HAL Research Document"))
    text = F.concat(F.lit("[HAL EU Repository] "), F.substring(F.coalesce(F.try_element_at(x["abstract_s"], F.lit(1)), empty), 1, 300))
    first = _rows(one, "regional", _first(F.concat(F.lit("https://doi.org/"), _first(x["doiId_s"])), x["uri_s"]), title, text, F.lit("PRIMARY_RESEARCH"), x["producedDateY_i"], F.lit(0.91))
    two = _items(answers, "articles array<struct<link:string,name:string,annotation:string,year:int,journal:string>>", "j.articles")
    link = F.when(x["link"].startswith("/"), F.concat(F.lit("https://cyberleninka.ru"), x["link"])).otherwise(x["link"])
    text = F.concat(F.lit("["), F.coalesce(_first(x["journal"]), F.lit("КиберЛенинка")), F.lit(", "), F.coalesce(x["year"].cast("string"), empty), F.lit("] "), F.substring(F.coalesce(x["annotation"], empty), 1, 300))
    second = _rows(two, "regional", link, F.coalesce(_first(x["name"]), F.lit("Научная статья")), text, F.lit("PRIMARY_RESEARCH"), x["year"], F.lit(0.90))
    both = first.withColumn("hub", F.lit(0)).unionByName(second.withColumn("hub", F.lit(1)))
    return grouped_positions(both, ["query_id", "goal_id"], [F.col("hub"), F.col("provider_rank"), F.col("url")], "_p").where(F.col("_p") < most).drop("hub", "_p")


class _Results:
    """Results of a page in either of two layouts: titles and snippets in blocks, or two columns of a table."""

    def __init__(self) -> None:
        self.blocks: list[list] = []  # address, title, snippet, number of the snippet
        self.links: list[list[str]] = []
        self.snippets: list[list[str]] = []
        self.title: list[str] | None = None
        self.number = 0

    def start(self, tag, attrs, above):
        names = attrs.get("class", "").split()
        if tag == "a" and "result-link" in names:
            self.links.append([attrs.get("href", ""), ""])
        elif tag == "td" and "result-snippet" in names:
            self.snippets.append(["", ""])
        elif tag == "a" and any("result__title" in a.get("class", "").split() for _, a in above):
            self.title = [attrs.get("href", ""), ""]
        if "result__snippet" in names:
            self.number += 1
            self.blocks.append([*(self.title or ("", "")), "", self.number])  # without a title the address is empty
            self.title = None

    def text(self, data, above):
        inside = {name for _, a in above for name in a.get("class", "").split()}
        if "result-link" in inside:
            self.links[-1][1] += data
        elif "result-snippet" in inside:
            self.snippets[-1][1] += data
        elif "result__snippet" in inside:
            self.blocks[-1][2] += data
        elif "result__title" in inside and self.title is not None:
            self.title[1] += data

    def end(self, tag, attrs, above):
        pass

    def rows(self) -> list[tuple[str, str, str, int]]:
        tidy = lambda x: " ".join(x.split())
        if any(href for href, *_ in self.blocks):
            return [(href, tidy(title), tidy(text), n) for href, title, text, n in self.blocks if href]
        texts = [tidy(t) for _, t in self.snippets]
        return [(href, tidy(title), texts[k] if k < len(texts) else "", k + 1) for k, (href, title) in enumerate(self.links)]


def web_results(answers: DataFrame, most: int = 20) -> DataFrame:
    """Result pages (HTML) in the block layout, else in the table layout; redirects unwrapped, http addresses off the engine's own host."""
    from tessera.functions.urls import unwrapped
    from tessera.operators.markup import walk

    schema = "query_id string, goal_id string, href string, title string, snippet string, pos int"

    def run(parts):
        for part in parts:
            out = []
            for query, goal, body in zip(part["query_id"], part["goal_id"], part["body"]):
                reader = _Results()
                walk(body or "", reader)
                out += [(query, goal, *row) for row in reader.rows()]
            yield pd.DataFrame(out, columns=["query_id", "goal_id", "href", "title", "snippet", "pos"])

    rows = answers.select("query_id", "goal_id", "body").mapInPandas(run, schema).withColumn("url", unwrapped(F.col("href")))
    rows = rows.where(F.col("url").startswith("http") & ~F.contains("url", F.lit("duckduckgo.com")))
    rows = rows.select("query_id", "goal_id", (F.col("pos") - 1).alias("pos"), "url", "title", "snippet")
    kept = grouped_positions(rows, ["query_id", "goal_id"], [F.col("pos")], "_p").where(F.col("_p") < most)
    return _rows(kept, "web_search", F.col("url"), F.col("title"), F.substring("snippet", 1, 300), F.lit("OFFICIAL_DOC"), F.lit(None), F.lit(0.70))


IMAGE = ["query_id", "url", "caption", "alt", "width", "height", "source_domain", "license", "author"]


def image_answers(answers: DataFrame) -> DataFrame:
    """Image candidates of a media archive (files with descriptions) and of an encyclopedia (lead pictures of articles)."""
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    value = "struct<value:string>"
    meta = ",".join(f"{n}:{value}" for n in ("ObjectName", "ImageDescription", "LicenseShortName", "UsageTerms", "Artist", "Author", "Credit"))
    schema = f"query struct<pages:map<string,struct<title:string,imageinfo:array<struct<url:string,width:int,height:int,extmetadata:struct<{meta}>>>,thumbnail:struct<source:string,width:int,height:int>>>>"
    rows = answers.select("query_id", F.explode(F.map_values(F.from_json("body", schema)["query"]["pages"])).alias("x"))
    info, thumb = F.try_element_at(F.col("x.imageinfo"), F.lit(1)), F.col("x.thumbnail")
    title = F.coalesce(F.col("x.title"), F.lit(""))
    name = F.replace(F.replace(title, F.lit("File:"), F.lit("")), F.lit("_"), F.lit(" "))
    told = lambda *names: _first(*[info["extmetadata"][n]["value"] for n in names])
    caption = F.coalesce(_first(F.substring(plain(F.coalesce(told("ObjectName", "ImageDescription"), name)), 1, 200)), name)
    licence = F.coalesce(_first(F.trim(told("LicenseShortName", "UsageTerms"))), F.lit("UNKNOWN_LICENSE"))
    author = F.coalesce(_first(plain(told("Artist", "Author", "Credit"))), F.lit("UNKNOWN_AUTHOR"))
    files = rows.select("query_id", info["url"].alias("url"), caption.alias("caption"), name.alias("alt"), info["width"].alias("width"), info["height"].alias("height"), F.lit("commons.wikimedia.org").alias("source_domain"), licence.alias("license"), author.alias("author"))
    leads = rows.select("query_id", thumb["source"].alias("url"), F.concat(title, F.lit(" - Main Diagram/Photo")).alias("caption"), title.alias("alt"), thumb["width"].alias("width"), thumb["height"].alias("height"), F.lit("en.wikipedia.org").alias("source_domain"), F.lit("CC BY-SA 4.0").alias("license"), F.lit("Wikipedia Contributors").alias("author"))
    return files.unionByName(leads).where("url <> ''").select(*IMAGE)


READERS = {f.__name__: f for f in (openalex, crossref, semantic_scholar, arxiv, europe_pmc, pubmed, wikipedia, github, general, regional, web_results)}


def discover(answers: dict[str, DataFrame], domain: str | None = None, opt_in: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Candidates of all services, the first of each address by (query, service order, rank), and a report.

    ``answers`` maps a reader's name to its answers; readers named in ``opt_in`` are left out.
    ``domain`` keeps the addresses of one domain. The report has provider, found, kept.
    """
    from tessera.functions.urls import matches_domain

    rows = None
    for place, (name, df) in enumerate((n, d) for n, d in answers.items() if n not in opt_in):
        one = READERS[name](df).select(*CANDIDATE, F.lit(place).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no services")
    near = rows.where(matches_domain(F.col("url"), domain)) if domain else rows
    kept = first_by(near, ["url"], ["query_id", "place", "provider_rank"]).drop("place")
    report = rows.groupBy("provider").agg(F.count("*").alias("found")).join(kept.groupBy("provider").agg(F.count("*").alias("kept")), "provider", "left").na.fill(0, ["kept"])
    return kept, report


def merged_seeds(preferred: DataFrame, found: DataFrame) -> DataFrame:
    """Preferred addresses (url, pos) before found ones, each once, in order: url, place of origin, pos."""
    both = preferred.select("url", F.lit(0).alias("origin"), "pos").unionByName(found.select("url", F.lit(1).alias("origin"), "pos"))
    return first_by(both.where("url is not null"), ["url"], ["origin", "pos"])


def open_access(pages: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """Adds rescue_url to refused pages (url, title): the PDF or landing page known for its DOI, else for its title."""
    from tessera.functions.urls import doi

    first = by_doi.groupBy(F.lower("doi").alias("_doi")).agg(F.min(_first(F.col("pdf_url"), F.col("landing_url"))).alias("_a"))
    second = by_title.groupBy(F.lower("title").alias("_title")).agg(F.min(_first(F.col("pdf_url"), F.col("landing_url"))).alias("_b"))
    rows = pages.withColumn("doi", doi(F.col("url")))
    rows = rows.join(first, F.lower("doi") == F.col("_doi"), "left").join(second, F.lower("title") == F.col("_title"), "left")
    return rows.withColumn("rescue_url", F.coalesce("_a", "_b")).drop("_doi", "_title", "_a", "_b")


def json_lines(spark, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a line that doesn't parse has nulls and stands in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def pool(preferred: DataFrame, found: DataFrame, fallback: str) -> DataFrame:
    """Preferred and found addresses (url, pos) in order, each once; ``fallback`` alone where there is none."""
    some = merged_seeds(preferred, found)
    spare = some.sparkSession.createDataFrame([(fallback, 2, 0)], "url string, origin int, pos int")
    none = some.limit(1).agg(F.count("*").alias("n")).where("n = 0").select()
    return some.unionByName(spare.join(none).select("url", "origin", "pos"))  # one row at most on either side
