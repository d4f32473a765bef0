"""Images and files that pages name: candidates, scores, tiles, file names."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.dedup import first_by
from tessera.operators.markup import _each, decoded, walk
from tessera.operators.positions import grouped_positions

#: File kinds (fixed values) that count as documents.
DOCUMENT_ENDS = (".pdf", ".docx", ".xlsx", ".pptx", ".csv", ".zip")
PICTURE_HOSTS = ("wikimedia", "wikipedia", "pubmed", "ncbi", "arxiv", "nature.com", "sciencedirect", "biorxiv", "medrxiv", "springer", "ieee", "wiley")
LEAST_SIDE, LEAST_RELEVANCE = 160, 0.55
EXCLUDED_WORDS = ("logo", "icon", "avatar", "sprite", "banner", "pixel", "placeholder")
IMAGES = "artifact_id bigint, url string, alt string, width int, height int, origin string, position int"
FILES = "artifact_id bigint, url string"


def best_source(srcset: str) -> str | None:
    """The address with the greatest width or density of a srcset; the first of equal ones."""
    best = (0.0, None)
    for part in (srcset or "").split(","):
        words = part.split()
        if words:
            try:
                size = float(words[1][:-1]) if len(words) > 1 else 1.0
            except ValueError:
                size = 1.0
            if size > best[0]:
                best = (size, words[0])
    return best[1]


class _Images:
    def __init__(self, base: str) -> None:
        self.base, self.rows, self.seen = base or "", [], set()

    def add(self, address, alt, width, height, origin):
        if not address or address.startswith("data:"):
            return
        try:
            full = urljoin(self.base, address)
        except ValueError:
            return
        if full not in self.seen:
            self.seen.add(full)
            number = lambda x: int(x) if x and x.isdigit() and len(x) < 7 else None
            self.rows.append((full, alt or "", number(width), number(height), origin, len(self.rows) + 1))

    def start(self, tag, attrs, above):
        if tag == "meta" and attrs.get("property", attrs.get("name", "")) in ("og:image", "twitter:image"):
            self.add(attrs.get("content"), "", None, None, "meta")
        elif tag == "img":
            self.add(best_source(attrs.get("srcset", "")) or attrs.get("src") or attrs.get("data-src"), attrs.get("alt"), attrs.get("width"), attrs.get("height"), "img")
        elif tag == "source" and any(t == "picture" for t, _ in above):
            self.add(best_source(attrs.get("srcset", "")), "", None, None, "picture")

    def text(self, data, above):
        pass

    def end(self, tag, attrs, above):
        pass


def images(pages: DataFrame) -> DataFrame:
    """Image candidates of pages (artifact_id, url, raw_content) in order, each address once a page."""

    def make(key, base, raw):
        reader = _Images(base)
        walk(decoded(raw), reader)
        return [(key, *row) for row in reader.rows]

    return _each(pages, ["artifact_id", "url", "raw_content"], make, IMAGES)


def document_files(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """artifact_id and url of documents: of links (artifact_id, url) with a document's ending, and the PDFs that
    addresses imply, of links and of ``pages`` (artifact_id, url): a preprint's abstract, an archived article's number."""
    url = F.lower("url")
    plain = links.where(url.rlike("(" + "|".join(e.replace(".", "\\.") for e in DOCUMENT_ENDS) + r")([?#]|$)")).select("artifact_id", "url")
    places = links.select("artifact_id", "url") if pages is None else links.select("artifact_id", "url").unionByName(pages.select("artifact_id", "url"))
    paper = places.withColumn("n", F.regexp_extract("url", r"(?i)arxiv\.org/(?:abs|html)/(\d[\w.]*)", 1)).where("n <> ''").select("artifact_id", F.concat(F.lit("https://arxiv.org/pdf/"), "n", F.lit(".pdf")).alias("url"))
    archived = places.withColumn("n", F.upper(F.regexp_extract("url", r"(?i)\b(PMC\d+)", 1))).where("n <> ''").select("artifact_id", F.concat(F.lit("https://europepmc.org/backend/ptpmcrender.fcgi?accid="), "n", F.lit("&blobtype=pdf")).alias("url"))
    return plain.unionByName(paper).unionByName(archived).distinct()


def image_relevance(df: DataFrame) -> DataFrame:
    """Adds relevance to images with query, url, caption, alt, source_domain, primary, width, height; drops what can't be used.

    Base .30 (.35 for a page's own picture); up to .45 for the share of query words found among the words
    of caption, alternative text and file name (words of four letters also by their beginning); .15
    for a known host; for known sizes .15 if large, -.3 if tiny, .05 or -.1 for the shape. Dropped:
    decoration, sides under 160, and with a query a relevance under .55.
    """
    name = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"\+", "%2B")), F.regexp_extract("url", r"([^/]*)$", 1)))
    text = F.concat_ws(" ", F.lower(F.coalesce("caption", F.lit(""))), F.lower(F.coalesce("alt", F.lit(""))), name)
    rows = df.withColumn("_text", text).withColumn("_words", T.tokens(text)).withColumn("_asked", T.tokens(F.col("query")))
    begins = lambda a, b: a.startswith(b) | b.startswith(a)
    met = lambda t: F.array_contains("_words", t) | ((F.length(t) >= 4) & F.exists("_words", lambda w: (F.length(w) >= 4) & begins(w, t)))
    share = F.when(F.size("_asked") > 0, F.size(F.filter("_asked", met)) / F.greatest(F.size("_asked"), F.lit(1))).otherwise(0.0)
    known = F.exists(F.array(*[F.lit(h) for h in PICTURE_HOSTS]), lambda h: F.contains(F.lower(F.coalesce("source_domain", F.lit(""))), h))
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    shape = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    size = F.when((F.col("width") >= 400) & (F.col("height") >= 300), 0.15).when((F.col("width") < 120) | (F.col("height") < 120), -0.3).otherwise(0.0)
    by_size = F.when(sized, size + F.when(shape.between(0.4, 2.5), 0.05).otherwise(-0.1)).otherwise(0.0)
    score = F.when(F.coalesce("primary", F.lit(False)), 0.35).otherwise(0.30) + share * 0.45 + F.when(known, 0.15).otherwise(0.0) + by_size
    rows = rows.withColumn("relevance", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), score)), 3))
    plain = F.exists(F.array(*[F.lit(w) for w in EXCLUDED_WORDS]), lambda w: F.contains("_text", w))
    large = (F.coalesce("width", F.lit(LEAST_SIDE)) >= LEAST_SIDE) & (F.coalesce("height", F.lit(LEAST_SIDE)) >= LEAST_SIDE)
    return rows.where(~plain & large & ((F.size("_asked") == 0) | (F.col("relevance") >= LEAST_RELEVANCE))).drop("_text", "_words", "_asked")


def ranked_images(df: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` images of each query_id by relevance and address, both descending, each address once; place from 0."""
    once = first_by(df.where("url <> ''"), ["query_id", "url"], ["position"])
    placed = grouped_positions(image_relevance(once), ["query_id"], [F.desc("relevance"), F.desc("url")], "place")
    return placed.where(F.col("place") < most)


#: First bytes (fixed values) of the kinds of media files.
MAGIC = (("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"), ("pdf", "25504446"), ("zip", "504B0304"))


def magic_kind(content: Column) -> Column:
    """Kind of a file by its first bytes; null if it is none of the known ones."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")
    for name, start in MAGIC:
        kind = kind.when(head.startswith(start), name)
    return kind


def accepted(url: Column, width: Column, height: Column, score: Column, least: float = 0.55) -> Column:
    """Large enough (unknown sizes pass), relevant enough, and no word of decoration in its address."""
    plain = F.exists(F.array(*[F.lit(w) for w in EXCLUDED_WORDS]), lambda w: F.contains(F.lower(url), w))
    return (F.coalesce(width, F.lit(160)) >= 160) & (F.coalesce(height, F.lit(160)) >= 160) & (score >= least) & ~plain


def tiles(df: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """x, y, tile_width, tile_height of the tiles that cover pictures (id, width, height)."""
    step = size - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    rows = df.where("width > 0 and height > 0").withColumn("y", F.explode(starts(F.col("height")))).withColumn("x", F.explode(starts(F.col("width"))))
    return rows.select("id", "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("tile_width"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("tile_height"))


def media_name(url: Column, title: Column) -> Column:
    """A file name: slug of the title, eight digits of the address' hash, the address' ending (jpg if it has none)."""
    end = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})(?:[?#]|$)", 1))
    return F.concat(F.coalesce(F.when(T.slug(title) != "", F.substring(T.slug(title), 1, 60)), F.lit("media")), F.lit("_"), F.substring(F.sha2(url, 256), 1, 8), F.lit("."), F.when(end != "", end).otherwise("jpg"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed to urls (host, path) by rules (host, prefix, allow): the longest prefix decides, allow wins ties, no rule allows.

    Each path is joined by its own prefixes, so the join is on equality.
    """
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda i: F.substring(F.col("path"), F.lit(1), i))
    parts = urls.select("host", "path").distinct().withColumn("prefix", F.explode(cut))
    hit = parts.join(rules, ["host", "prefix"]).groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("rule"))
    return urls.join(hit, ["host", "path"], "left").withColumn("allowed", F.coalesce("rule", F.lit(True))).drop("rule")


def blocked_ip(address: Column) -> Column:
    """Private, local, reserved, multicast or unspecified, for both kinds of addresses (mapped IPv4 counts as IPv4); null if it is none."""

    from tessera.functions.urls import is_blocked_ipv4

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        def one(a):
            try:
                ip = ipaddress.ip_address((a or "").strip("[]"))
            except ValueError:
                return None
            ip = getattr(ip, "ipv4_mapped", None) or ip
            return bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

        return s.map(one)

    return F.coalesce(is_blocked_ipv4(address), F.when(F.contains(address, F.lit(":")), test(address)))  # only IPv6 goes to Python
