"""Problem 5: cut oversized items into pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16  # characters in the rolling hash
LANDMARK = 128  # one landmark in so many characters, on average
_GEAR = np.random.RandomState(20240229).randint(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32)
_SPACE = re.compile(r"\S+")
_BREAKS = ((3, re.compile(r"\n\s*\n|\n(?=#{1,6} )")), (2, re.compile(r"\n")), (1, re.compile(r"(?<=[.!?。！？…])\s+|(?<=[。！？])")))
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)

PIECES = "tbl string, rec_id string, piece_no int, n_pieces int, start int, end int, heading_path array<string>, token_estimate int, overlap_tokens int, text string"


def tokens(text: str | None) -> int:
    """The larger of floor(1.3 words) and floor(characters / 3.5), at least 1 for a text that is not empty."""
    return max(int(1.3 * len(text.split())), int(len(text) / 3.5), 1) if text else 0


def landmarks(text: str) -> np.ndarray:
    """Places whose rolling hash over the last WINDOW characters has its lower bits clear."""
    g = _GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % 4096]
    h = np.zeros(len(g), np.uint32)
    for k in range(WINDOW):
        h[k:] += g[: len(g) - k] << np.uint32(k)
    return np.flatnonzero((h >> np.uint32(16)) % LANDMARK == 0) + 1


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``: each of at most ``limit`` tokens, together the whole text.

    The cut is the natural boundary nearest to the first landmark past the minimum size: the start
    of a paragraph or heading, else of a line, a sentence or a word, else any place. A piece starts
    at most ``overlap`` tokens before the end of the piece before it, and at least half as many: at
    the start of a sentence there, else of a word, else (in text without spaces) at any character.
    A text within the limit is one piece; a limit below 1 counts as 1. An overlap must leave room to
    go on: it is at most limit - 1 and gives way by the one word more that would not fit.
    """
    limit = max(limit, 1)
    if tokens(text) <= limit:
        return [(0, len(text))] if text else []
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    word = np.zeros(n + 1, np.int64)
    starts = np.fromiter((m.start() for m in _SPACE.finditer(text)), np.int64)
    word[starts] = 1
    before = np.concatenate([[0], np.cumsum(word)])  # word starts before a place
    solid = np.zeros(n + 2, bool)
    for m in _SPACE.finditer(text):
        solid[m.start() : m.end()] = True

    def size(a: int, b: int) -> int:
        words = int(before[b] - before[a]) + (1 if a < b and solid[a] and not word[a] else 0)
        return max(int(1.3 * words), int((b - a) / 3.5), 1)

    def furthest(a: int, most: int) -> int:
        low, high = a + 1, n
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if size(a, mid) <= most else (low, mid - 1)
        return low

    def first(low: int, high: int, good) -> int:
        """The first place from low on for which ``good`` holds; it holds from there to high."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if good(mid) else (mid + 1, high)
        return low

    def restart(a: int, cut: int) -> int:
        """Where the piece after (a, cut) starts."""
        if not overlap:
            return cut
        low = first(a + 1, cut, lambda x: size(x, cut) <= overlap)
        low = first(low, cut, lambda x: furthest(x, limit) > cut)
        half = first(low, cut - 1, lambda x: size(x, cut) <= max(1, (overlap + 1) // 2))
        for places in (levels[1], starts):
            at = np.searchsorted(places, low)
            if at < len(places) and places[at] <= half:
                return int(places[at])
        return low

    marks, levels = landmarks(text), {level: np.array([m.end() for m in pattern.finditer(text)], np.int64) for level, pattern in _BREAKS}
    spans, a = [], 0
    while True:
        most = furthest(a, limit)
        if most >= n:
            spans.append((a, n))
            return spans
        new = furthest(spans[-1][1], max(1, (limit - overlap) // 2)) if spans else 0  # half of the room beyond the overlap
        least = min(most, max(a + 1, furthest(a, max(1, limit // 2)), new))
        at = np.searchsorted(marks, least)
        goal = int(marks[at]) if at < len(marks) and marks[at] <= most else most
        cut = most
        for places in (levels[3], levels[2], levels[1], starts):
            near = places[np.searchsorted(places, least) : np.searchsorted(places, most, side="right")]
            if len(near):
                cut = int(near[np.argmin(np.abs(near - goal))])
                break
        spans.append((a, cut))
        a = restart(a, cut)


def heading_at(text: str, places: list[int]) -> list[list[str]]:
    """The Markdown headings in force at each place (ascending)."""
    found = [(m.start(), len(m.group(1)), m.group(2)) for m in _HEADING.finditer(text)]
    path: list[tuple[int, str]] = []
    out, k = [], 0
    for p in places:
        while k < len(found) and found[k][0] <= p:
            path = [x for x in path if x[0] < found[k][1]] + [found[k][1:]]
            k += 1
        out.append([title for _, title in path])
    return out


def split_items(items: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of ``items`` (tbl, rec_id, text, heading_path, limit_tokens, overlap_tokens).

    Null and empty texts give no pieces, a null limit leaves the text whole. Each piece has the
    heading path in force at its start (Markdown headings of the text below the given path) and its
    own token estimate. Equal rows give equal pieces; extra columns are ignored.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["text"]
                if not text:
                    continue
                limit = r["limit_tokens"] if r["limit_tokens"] is not None else tokens(text)
                spans = split(text, limit, r["overlap_tokens"] or 0)
                given = [x for x in r["heading_path"] or [] if x is not None]
                paths = heading_at(text, [a for a, _ in spans]) if len(spans) > 1 and "#" in text else [[]] * len(spans)
                last = 0
                for k, ((a, b), path) in enumerate(zip(spans, paths)):
                    shared = tokens(text[a:last]) if a < last else 0
                    rows.append((r["tbl"], r["rec_id"], k, len(spans), a, b, given + path, tokens(text[a:b]), shared, text[a:b] if with_text else None))
                    last = b
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=_SCHEMA)

    return items.select("tbl", "rec_id", "text", "heading_path", "limit_tokens", "overlap_tokens").mapInArrow(run, PIECES)


_SCHEMA = pa.schema([("tbl", pa.string()), ("rec_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("heading_path", pa.list_(pa.string())), ("token_estimate", pa.int32()), ("overlap_tokens", pa.int32()), ("text", pa.string())])


def oversized(extracted: DataFrame, chunks: DataFrame, limits: DataFrame, unique: bool = True) -> DataFrame:
    """The items of both tables with their limits, one row per key (repeated rows carry one text)."""
    empty = F.array().cast("array<string>")
    parts = extracted.select(F.lit("extracted_content").alias("tbl"), F.col("content_id").alias("rec_id"), F.col("clean_markdown").alias("text"), empty.alias("heading_path")).unionByName(
        chunks.select(F.lit("structured_chunks").alias("tbl"), F.col("chunk_id").alias("rec_id"), "text", F.coalesce("heading_path", empty).alias("heading_path"))
    )
    if unique:
        parts = parts.groupBy("tbl", "rec_id").agg(F.max_by(F.struct("text", "heading_path"), F.struct(F.length("text"), "text")).alias("r")).select("tbl", "rec_id", "r.*")
    small = F.broadcast(limits.groupBy(F.col("item_type").alias("tbl")).agg(F.max("limit_tokens").alias("limit_tokens"), F.max("overlap_tokens").alias("overlap_tokens")).where(F.col("tbl").isin("extracted_content", "structured_chunks")))
    return parts.join(small, "tbl", "left")
