"""Problem 6: lines repeated across the documents of one site, by content-defined pieces.

Landmarks are the places of a text whose rolling hash over the last WINDOW characters has its lower bits
clear; line ends are no landmarks, and pieces run across them. Landmarks whose window lies inside a line
depend on that line alone, so a piece between two of them comes back wherever the line does. Each line
is represented by the one of its own pieces with the smallest hash. Pieces are counted by different
chunks per site, those repeated excessively are cut, and with them the lines that they represent, after
an exact count of the whole line. A line too short to have a piece of its own stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import host
from tessera.session import materialise

WINDOW = 4  # characters in the rolling hash
PIECE = 8  # mean characters between landmarks
SALTS = 16  # parts of a hot piece or line in the joins
MIN_DOCUMENTS = 6
_DIGITS = re.compile(r"\d+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_GEAR = np.random.RandomState(977).randint(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32)
LINES = "site string, chunk_id string, line_no int, line bigint, piece bigint, short boolean"


def normal(line: str) -> str:
    """The line without what may differ: letter case, white space, the value of digit runs."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def pieces(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each normalised line of a text: its hash, the hash of the piece that represents it, and whether it is short."""
    text = "\n".join(lines) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    ends = np.flatnonzero(c == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    g = _GEAR[c % 4096]
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h[k:] += g[: n - k] << np.uint32(k)
    marks = np.flatnonzero((h >> np.uint32(12)) % PIECE == 0) + 1  # a piece starts after a landmark
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    inverse = _powers(_INVERSE, n + 1)
    whole = _mixed((prefix[ends] - prefix[starts]) * inverse[starts])
    a, b = marks[:-1], marks[1:]
    line = np.searchsorted(starts, a, side="right") - 1
    own = (a - starts[line] >= WINDOW) & (b <= ends[line])
    a, b, line = a[own], b[own], line[own]
    found = _mixed((prefix[b] - prefix[a]) * inverse[a])
    best = np.full(len(lines), np.iinfo(np.int64).max)
    np.minimum.at(best, line, found)
    short = np.ones(len(lines), bool)
    short[line] = False
    return whole, np.where(short, whole, best), short


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site, chunk, text = (batch.column(k).to_pylist() for k in range(3))
        for at in range(0, len(text), 1000):
            owner, number, lines = [], [], []
            for i in range(at, min(at + 1000, len(text))):
                for k, raw in enumerate((text[i] or "").split("\n")):
                    if line := normal(raw):
                        owner.append(i)
                        number.append(k)
                        lines.append(line)
            if lines:
                whole, found, short = pieces(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([site[i] for i in owner], pa.string()), pa.array([chunk[i] for i in owner], pa.string()), pa.array(number, pa.int32()), pa.array(whole), pa.array(found), pa.array(short)],
                    names=["site", "chunk_id", "line_no", "line", "piece", "short"],
                )


def _often(rows: DataFrame, key: str, least: int) -> DataFrame:
    """The values of ``key`` that occur in at least ``least`` chunks, once for each salt."""
    found = rows.select(key, "chunk").distinct().groupBy(key).agg(F.count("*").alias("chunks")).where(F.col("chunks") >= least)
    return found.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")


def represented_lines(chunks: DataFrame) -> DataFrame:
    """site, chunk_id, line_no, the hashes line and piece (with the site), short, chunk, salt of each non-blank line."""
    rows = chunks.select(host(F.col("source_url")).alias("site"), "chunk_id", "text").where("site is not null and chunk_id is not null and text is not null")
    lines = rows.mapInArrow(_lines, LINES).withColumn("line", F.xxhash64("site", "line")).withColumn("piece", F.xxhash64("site", "piece", "short"))
    chunk = F.xxhash64("chunk_id")
    return lines.withColumn("chunk", chunk).withColumn("salt", F.pmod(chunk, F.lit(SALTS)).cast("int"))


def repeated_lines(chunks: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """Lines whose content occurs in at least ``least`` different chunk_ids of one site.

    Columns: site, chunk_id, line_no, short. Blank lines, null texts and rows without chunk_id or site
    take no part; repeated rows count once. Counting runs on (site, piece, chunk) keys with partial
    aggregation, and a piece that a third of all chunks have is joined in SALTS parts.
    """
    lines = materialise(represented_lines(chunks))
    candidates = lines.join(_often(lines, "piece", least), ["piece", "salt"], "left_semi")
    kept = candidates.join(_often(candidates, "line", least), ["line", "salt"], "left_semi")
    return kept.select("site", "chunk_id", "line_no", "short").distinct()


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunk_id and text of each chunk (one row per chunk_id) without the found lines; null texts stay null."""
    one = chunks.select("chunk_id", "text").groupBy("chunk_id").agg(F.max("text").alias("text"))
    drop = found.groupBy("chunk_id").agg(F.collect_set("line_no").alias("drop"))
    keep = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    return one.join(drop, "chunk_id", "left").select("chunk_id", F.when(F.col("text").isNotNull(), F.array_join(keep, "\n")).alias("text"))
