"""Choosing how to acquire pages, merging what the tiers brought, and keyed picks per page and run."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators.dedup import first_by
from tessera.operators.markup import decoded, walk
from tessera.operators.positions import grouped_positions


def backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds before the next attempt: two to its power, at most 60, times a given jitter."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt)) * jitter


def next_strategy(strategy: Column, quality: Column, api: Column, visual: Column, enough: float = 0.85, threshold: float = 0.6) -> Column:
    """The tier to try next; the same one where the quality is enough or nothing is above it."""
    up = F.when(strategy == "cache", "http").when(strategy == "http", F.when(api, "api").otherwise("browser"))
    up = up.when(strategy.isin("api", "browser"), F.when(visual >= threshold, "visual").otherwise("semantic")).when(strategy == "semantic", "visual").otherwise(strategy)
    return F.when(quality >= enough, strategy).otherwise(up)


def needs_browser(mode: Column, js_score: Column, block_score: Column, screenshot: Column, failed: Column, threshold: float = 0.70) -> Column:
    """Never in fast mode; always for screenshots, research and complete runs, failed pages, pages with scripts or blocks."""
    wanted = screenshot | mode.isin("research", "complete") | failed | (F.coalesce(js_score, F.lit(0.0)) >= threshold) | (F.coalesce(block_score, F.lit(0.0)) >= 0.5)
    return F.when(mode == "fast", False).otherwise(F.coalesce(wanted, F.lit(False)))


#: Tiers (fixed values) in the order in which a page's results are preferred.
TIERS = ("api", "browser", "http", "cache")


def best_capture(captures: DataFrame, columns: tuple[str, ...] = ("artifact_id", "strategy_used")) -> DataFrame:
    """canonical_url and ``columns`` of one capture of each address: with content before without, the higher tier, the newest.

    A content is a text that isn't blank. Rows without an address are dropped; unknown tiers come last.
    Texts are looked at where they are and don't take part in the aggregation, unless asked for.
    """
    tier = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("strategy_used")), F.lit(0))
    empty = F.coalesce(F.trim("text_content") == "", F.lit(True)).cast("int")
    order = {"_empty": empty, "_tier": F.when(tier == 0, len(TIERS) + 1).otherwise(tier), "_age": -F.coalesce(F.unix_micros("captured_at"), F.lit(0)), "_id": F.col("artifact_id")}
    rows = captures.where("canonical_url is not null").select("canonical_url", *columns, *[c.alias(n) for n, c in order.items()])
    return first_by(rows, ["canonical_url"], list(order)).drop(*order)


def capped(df: DataFrame, page: str, order: list[Column], per_page: int = 3, per_run: int = 20) -> DataFrame:
    """The first ``per_page`` rows of each page, of these the first ``per_run``; the place in the run is added as place."""
    first = grouped_positions(df, [page], order, "_n").where(F.col("_n") < per_page).drop("_n")
    return grouped_positions(first, [], order, "place").where(F.col("place") < per_run)


def state_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("state").agg(F.count("*").alias("n"))


def idempotency_key(execution: Column, node: Column, revision: Column, payload: Column) -> Column:
    """execution:node:r<revision>:<16 digits of the SHA-256 of the payload as JSON>."""
    return F.concat_ws(":", execution, node, F.concat(F.lit("r"), revision.cast("string")), F.substring(F.sha2(F.to_json(payload), 256), 1, 16))


def canonical_link(html: Column) -> Column:
    """The address of the canonical link element; null if there is none."""
    tag = F.regexp_extract(html, r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    found = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.when(found != "", found)


def is_pdf(content: Column) -> Column:
    """The mark of a PDF is among the first 1024 bytes."""
    return F.coalesce(F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-")), F.lit(False))


def in_scope(url: Column, domain: str | None, discover: bool) -> Column:
    """Whether a page may be followed: any page while sources are discovered, else those whose address holds the domain."""
    return F.lit(True) if discover or not domain else F.coalesce(F.contains(F.lower(url), F.lit(domain.lower())), F.lit(False))


def expansion_links(links: DataFrame, most: int = 10) -> DataFrame:
    """The links (page, url, score, is_navigation, is_footer) worth following, the best ``most`` of each page, with place.

    Not of navigation or footer, allowed as a final source and no binary document; each canonical
    address once a page with its best score; order by score, then address, both descending.
    """
    url = F.col("url")
    rows = links.where(~F.col("is_navigation") & ~F.col("is_footer") & U.rejection_reason(url).isNull() & ~U.is_binary_document(url))
    rows = rows.groupBy("page", U.canonical_url(url).alias("canonical")).agg(F.max("score").alias("score"))
    return grouped_positions(rows, ["page"], [F.desc("score"), F.desc("canonical")], "place").where(F.col("place") < most)


FOUND = "artifact_id bigint, tag string, text string, score double"
_SELECTOR = re.compile(r"^([a-z][a-z0-9]*)?(?:#([\w-]+))?(?:\.([\w-]+))?$", re.I)


class _Elements:
    """Every element with its attributes, its own text and its parent's."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.stack: list[dict] = []

    def start(self, tag, attrs, above):
        node = {"tag": tag, "attrs": attrs, "text": "", "parent": self.stack[-1] if self.stack else None, "depth": len(above)}
        self.rows.append(node)
        while self.stack and self.stack[-1]["depth"] >= len(above):
            self.stack.pop()
        node["parent"] = self.stack[-1] if self.stack else None
        self.stack.append(node)

    def text(self, data, above):
        while self.stack and self.stack[-1]["depth"] >= len(above):
            self.stack.pop()
        for node in self.stack:
            node["text"] += data

    def end(self, tag, attrs, above):
        pass


def locate(pages: DataFrame, selector: str, tag: str, attributes: dict[str, str], text: str, nearby: str) -> DataFrame:
    """The element that a simple selector (tag#id.class) names on each page, else the likest one.

    Likeness: .4 for the share of attribute names, .4 if the text is found in the element, .2 if the
    nearby text is found in its parent; at least .5, the first of equals. Pages (artifact_id,
    raw_content) without either give no row.
    """
    kind, ident, cls = _SELECTOR.match(selector).groups() if _SELECTOR.match(selector) else (None, None, None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, raw in zip(part["artifact_id"], part["raw_content"]):
                reader = _Elements()
                walk(decoded(raw), reader)
                hit = next((n for n in reader.rows if (not kind or n["tag"] == kind.lower()) and (not ident or n["attrs"].get("id") == ident) and (not cls or cls in n["attrs"].get("class", "").split())), None) if kind or ident or cls else None
                best, score = (hit, 1.0) if hit else (None, 0.0)
                if hit is None:
                    for n in (n for n in reader.rows if n["tag"] == tag):
                        s = 0.4 * len(attributes.keys() & n["attrs"].keys()) / max(1, len(attributes))
                        s += 0.4 * bool(text and text in n["text"]) + 0.2 * bool(nearby and n["parent"] and nearby in n["parent"]["text"])
                        if s > score and s >= 0.5:
                            best, score = n, s
                if best is not None:
                    out.append((key, best["tag"], " ".join(best["text"].split()), round(score, 6)))
            yield pd.DataFrame(out, columns=["artifact_id", "tag", "text", "score"])

    return pages.select("artifact_id", "raw_content").mapInPandas(run, FOUND)
