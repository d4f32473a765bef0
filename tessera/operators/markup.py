"""Links, tables and Markdown of pages, by one streaming pass of the standard HTML parser."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_NO_END = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_PARAGRAPHS = ("p", "li", "td", "article", "section")
_ASIDE = ("nav", "aside", "footer", "header", "form", "noscript", "iframe")
CONTEXT = 250  # characters of a link's paragraph
_SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:", "#")


def decoded(raw: bytes | None) -> str:
    """The text of a page in the charset that it declares; bytes that don't fit are replaced."""
    if not raw:
        return ""
    named = _CHARSET.search(raw)
    try:
        return raw.decode(named[1].decode("ascii", "replace") if named else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


class _Walk(HTMLParser):
    """Keeps the stack of open elements and tells a reader of starts, ends and text."""

    def __init__(self, reader) -> None:
        super().__init__(convert_charrefs=True)
        self.reader, self.open = reader, []

    def handle_starttag(self, tag, attrs):
        for other in _ENDS.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self.handle_endtag(other)
        attrs = {k: v or "" for k, v in attrs}
        self.reader.start(tag, attrs, self.open)
        if tag not in _NO_END:
            self.open.append((tag, attrs))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                last, attrs = self.open.pop()
                self.reader.end(last, attrs, self.open)
                if last == tag:
                    return

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.reader.text(data, self.open)


def walk(html: str, reader) -> None:
    w = _Walk(reader)
    w.feed(html)
    w.close()
    while w.open:
        w.handle_endtag(w.open[-1][0])


class _Links:
    def __init__(self, base: str) -> None:
        self.base, self.rows, self.seen, self.heading, self.position, self.now = base, [], set(), "", 0, None
        self.blocks: list[list[str]] = []  # text so far of the open elements that count as a link's paragraph

    def start(self, tag, attrs, above):
        if tag in _PARAGRAPHS:
            self.blocks.append([""])
        if tag in ("h1", "h2", "h3", "h4"):
            self.heading = ""
        if tag == "a" and "href" in attrs:
            self.position += 1
            href = attrs["href"]
            try:
                full = urljoin(self.base or "", href)
            except ValueError:
                return
            if not href or href.startswith(_SKIPPED_SCHEMES) or full in self.seen:
                return
            self.seen.add(full)
            near = above[-5:]
            says = lambda t, *words: any(tag_ == t or any(w in a.get("class", "").lower() or w in a.get("id", "").lower() for w in words) for tag_, a in near)
            self.now = [full, "", self.position, self.heading.strip(), says("nav", "nav", "menu", "header") or any(t == "header" for t, _ in near), says("footer", "footer"), says("aside", "sidebar"), self.blocks[-1] if self.blocks else [""]]
            self.rows.append(self.now)

    def text(self, data, above):
        if self.now is not None and any(t == "a" for t, _ in above):
            self.now[1] += data
        if above and above[-1][0] in ("h1", "h2", "h3", "h4"):
            self.heading += data
        for block in self.blocks:
            if len(block[0]) < 20 * CONTEXT:
                block[0] += data

    def end(self, tag, attrs, above):
        if tag == "a":
            self.now = None
        elif tag in _PARAGRAPHS and self.blocks:
            self.blocks.pop()


class _Tables:
    def __init__(self) -> None:
        self.done, self.stack = [], []

    def start(self, tag, attrs, above):
        if tag == "table":
            self.stack.append([])
        elif tag == "tr" and self.stack:
            self.stack[-1].append([])
        elif tag in ("td", "th") and self.stack:
            if not self.stack[-1]:
                self.stack[-1].append([])
            number = lambda k: min(max(int(attrs[k]), 1), 1000) if attrs.get(k, "").isdigit() else 1
            self.stack[-1][-1].append([tag, "", number("colspan"), number("rowspan")])

    def text(self, data, above):
        if self.stack and self.stack[-1] and self.stack[-1][-1] and any(t in ("td", "th") for t, _ in above):
            self.stack[-1][-1][-1][1] += data

    def end(self, tag, attrs, above):
        if tag == "table" and self.stack:
            self.done.append(grid(self.stack.pop()))


def grid(rows: list[list[list]]) -> tuple[list[str], list[list[str]]]:
    """Headers and rows of a table with spans filled in; the first row is the header if it has a header cell."""
    held: dict[tuple[int, int], str] = {}
    heads = set()
    for r, row in enumerate(rows):
        c = 0
        for kind, text, wide, tall in row:
            while (r, c) in held:
                c += 1
            if kind == "th":
                heads.add(r)
            for i in range(min(tall, len(rows) - r)):
                for j in range(wide):
                    held[r + i, c + j] = " ".join(text.split())
            c += wide
    width = max((c for _, c in held), default=-1) + 1
    full = [[held.get((r, c), "") for c in range(width)] for r in range(len(rows))]
    return (full[0], full[1:]) if full and 0 in heads else ([], full)


class _Markdown:
    """Markdown of a page; with ``within`` only of what is inside such an element and outside page furniture."""

    def __init__(self, within: str | None = None) -> None:
        self.lines, self.held, self.mark, self.within = [], "", "", within

    def wanted(self, above) -> bool:
        tags = [t for t, _ in above]
        return self.within is None or self.within in tags and not any(t in _ASIDE for t in tags)

    def flush(self):
        text = " ".join(self.held.split())
        if text:
            self.lines.append(self.mark + text)
        self.held, self.mark = "", ""

    def start(self, tag, attrs, above):
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "ul", "ol", "table", "br", "section", "article"):
            self.flush()
        if tag == "li":
            self.mark = "- "
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.mark = "#" * int(tag[1]) + " "
        elif tag in ("td", "th") and self.held.strip():
            self.held += " | "
        if tag in ("b", "strong"):
            self.held += "**"
        elif tag in ("i", "em"):
            self.held += "*"
        elif tag == "a" and attrs.get("href") and self.wanted(above):
            self.held += "["

    def text(self, data, above):
        if not any(t in ("head", "script", "style") for t, _ in above) and self.wanted(above):
            self.held += data

    def end(self, tag, attrs, above):
        if tag in ("b", "strong"):
            self.held += "**"
        elif tag in ("i", "em"):
            self.held += "*"
        elif tag == "a" and attrs.get("href") and self.wanted(above):
            self.held += f"]({attrs['href']})"
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article"):
            self.flush()


def _each(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([row for values in part.itertuples(index=False) for row in make(*values)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


LINKS = "artifact_id bigint, url string, anchor string, position int, heading string, is_navigation boolean, is_footer boolean, is_sidebar boolean, paragraph string"
TABLES = "artifact_id bigint, table_index int, headers array<string>, rows array<array<string>>, markdown string, json string, csv string"


def links(pages: DataFrame) -> DataFrame:
    """The links of pages (artifact_id, url, raw_content) in order, each absolute address once a page, with the
    last heading before it, the zone of the five elements above it, and the start of the text of the
    nearest paragraph, list item, cell, article or section around it. Null content gives none."""

    def make(key, base, raw):
        reader = _Links(base)
        walk(decoded(raw), reader)
        return [(key, u, " ".join(a.split()), p, h, n, f, s, " ".join(b[0].split())[:CONTEXT]) for u, a, p, h, n, f, s, b in reader.rows]

    return _each(pages, ["artifact_id", "url", "raw_content"], make, LINKS)


def table_markdown(headers: list[str], rows: list[list[str]]) -> str:
    escape = lambda c: c.replace("|", "\\|")
    width = max([len(headers), *map(len, rows)], default=0)
    top = headers or [f"col{i + 1}" for i in range(width)]
    lines = [top, ["---"] * width, *rows]
    return "\n".join("| " + " | ".join(map(escape, line)) + " |" for line in lines) if width else ""


def unique_keys(headers: list[str]) -> list[str]:
    """Keys for the cells of a row: an empty header is "col", a repeated one has its number added."""
    seen: Counter = Counter()
    out = []
    for h in (x or "col" for x in headers):
        seen[h] += 1
        out.append(h if seen[h] == 1 else f"{h}_{seen[h]}")
    return out


def table_json(headers: list[str], rows: list[list[str]]) -> str:
    """Rows as objects; columns beyond the headers are named col_<number>."""
    width = max([len(headers), *map(len, rows)], default=0)
    keys = unique_keys([*headers, *(f"col_{i + 1}" for i in range(len(headers), width))])
    return json.dumps([dict(zip(keys, r)) for r in rows], ensure_ascii=False)


def table_csv(headers: list[str], rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows([headers, *rows] if headers else rows)
    return out.getvalue()


def tables(pages: DataFrame) -> DataFrame:
    """The tables of pages (artifact_id, raw_content) with row and column spans filled in, also as Markdown, JSON and CSV."""

    def make(key, raw):
        reader = _Tables()
        walk(decoded(raw), reader)
        return [(key, i, h, r, table_markdown(h, r), table_json(h, r), table_csv(h, r)) for i, (h, r) in enumerate(reader.done)]

    return _each(pages, ["artifact_id", "raw_content"], make, TABLES)


def to_markdown(html: str, main: bool = False) -> str:
    """The page as Markdown; with ``main`` of its main, else its article, else its body without navigation and the like."""
    low = html.lower()
    reader = _Markdown(next((t for t in ("main", "article") if f"<{t}" in low), "body" if "<body" in low else None) if main else None)
    walk(html, reader)
    reader.flush()
    return "\n\n".join(reader.lines)


def markdown(pages: DataFrame) -> DataFrame:
    """artifact_id and Markdown of pages (artifact_id, raw_content); null content gives an empty text."""
    return _each(pages, ["artifact_id", "raw_content"], lambda key, raw: [(key, to_markdown(decoded(raw)))], "artifact_id bigint, markdown string")


def markdown_forms(pages: DataFrame) -> DataFrame:
    """artifact_id and three forms of each page: raw (all of it), clean (the main part), fit (without lone short links)."""
    rows = _each(pages, ["artifact_id", "raw_content"], lambda key, raw: [(key, to_markdown(decoded(raw)), to_markdown(decoded(raw), main=True))], "artifact_id bigint, raw string, clean string")
    rows = rows.select("artifact_id", T.clean_markdown(F.col("raw")).alias("raw"), T.clean_markdown(F.col("clean")).alias("clean"))
    return rows.withColumn("fit", T.clean_markdown(T.fit_markdown(F.col("clean"))))


def sitemap_urls(df: DataFrame) -> DataFrame:
    """url of each loc element of sitemaps (xml)."""
    return df.select(F.explode(F.xpath("xml", F.lit("//*[local-name()='loc']/text()"))).alias("url")).select(F.trim("url").alias("url")).where(F.col("url").startswith("http"))
