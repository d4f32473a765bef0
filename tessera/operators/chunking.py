"""Chunkers that follow the structure of a document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
CHUNKS = "document_id string, ordinal int, chunk_id string, heading_path array<string>, section int, text string, word_count int, token_estimate int, content_hash string"


def _tokens(text: str) -> int:
    return max(int(len(text.split()) * 1.3), int(len(text) / 3.5), 1) if text else 0


def _packed(pieces: list[str], target: int) -> list[str]:
    """Pieces joined by blanks as long as they stay within ``target`` words."""
    out, held, size = [], [], 0
    for p in pieces:
        n = len(p.split())
        if held and size + n > target:
            out.append(" ".join(held))
            held, size = [], 0
        held.append(p)
        size += n
    return [*out, " ".join(held)] if held else out


def _whole(text: str, target: int, strict: bool) -> list[str]:
    """A block within ``target`` words as it is, a longer one by sentences; ``strict`` also cuts long sentences by words."""
    if len(text.split()) <= target or text.startswith("|") and text.endswith("|") and not strict:
        return [text]
    pieces = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
    if strict:
        pieces = [" ".join(w[i : i + target]) for w in (p.split() for p in pieces) for i in range(0, len(w), target)]
    return _packed(pieces, target) or [text]


def blocks(markdown: str, title: str, target: int, nested: bool) -> Iterator[tuple[list[str], int, str]]:
    """(heading path, section number, text) of each block: the lines of a section up to ``target`` words.

    ``nested``: the path follows the heading levels; else it is title and heading.
    """
    path, section, held, size = [title] if title else [], 0, [], 0
    base = list(path)
    for line in markdown.splitlines():
        plain = line.strip()
        if plain.startswith("#"):
            if held:
                yield path, section, "\n\n".join(held).strip()
            held, size = [], 0
            level, name = len(plain) - len(plain.lstrip("#")), plain.lstrip("#").strip()
            path = [*(path[:level] if nested else base), name]
            section += 1
            continue
        if plain:
            held.append(line)
            size += len(line.split())
            if plain.startswith("|") and plain.endswith("|"):
                continue
        if held and size >= target:
            yield path, section, "\n\n".join(held).strip()
            held, size = [], 0
    if held:
        yield path, section, "\n\n".join(held).strip()


def chunk_documents(docs: DataFrame, target: int = 200, nested: bool = True, strict: bool = False) -> DataFrame:
    """Chunks of documents (document_id, title, markdown) of about ``target`` words.

    ``strict`` keeps every chunk within the target, cutting sentences by words; otherwise a sentence
    or table longer than the target stays whole. Ids follow from document and ordinal. Null and
    blank texts give none.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, title, text in zip(part["document_id"], part["title"], part["markdown"]):
                n = 0
                for path, section, block in blocks(text or "", title or "", target, nested):
                    for piece in _whole(block, target, strict):
                        if piece := piece.strip():
                            own = hashlib.sha256(f"{key}:{n}".encode()).hexdigest()[:12]
                            rows.append((key, n, own, list(path), section, piece, len(piece.split()), _tokens(piece), hashlib.sha256(piece.encode("utf-8", "replace")).hexdigest()))
                            n += 1
            yield pd.DataFrame(rows, columns=names)

    return docs.select("document_id", "title", "markdown").mapInPandas(run, CHUNKS)


def linked(chunks: DataFrame) -> DataFrame:
    """Adds previous_chunk_id and next_chunk_id: the ids follow from the ordinal, so neighbours are joined by key."""
    side = chunks.select("document_id", "ordinal", F.col("chunk_id").alias("_c"))
    before = side.select("document_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("_c").alias("previous_chunk_id"))
    after = side.select("document_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("_c").alias("next_chunk_id"))
    return chunks.join(before, ["document_id", "ordinal"], "left").join(after, ["document_id", "ordinal"], "left")


def paragraphs(docs: DataFrame, least: int = 30) -> DataFrame:
    """document_id, ordinal, text of each paragraph (parted by a blank line) of more than ``least`` characters."""
    trimmed = F.transform(F.split("markdown", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return docs.where("markdown is not null").select("document_id", F.posexplode(F.filter(trimmed, lambda p: F.length(p) > least)).alias("ordinal", "text")).withColumn("token_estimate", T.token_estimate(F.col("text")))
