"""Vectors of texts, nearest neighbours and passage search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators.positions import grouped_positions
from tessera.operators.ranking import fuse, rerank, select_diverse
from tessera.session import materialise

DIMENSIONS, SPARSE = 384, 100_000


def _unit_vectors(df: DataFrame, id_column: str, dimensions: int, bucket=V.bucket) -> DataFrame:
    words = df.select(F.col(id_column).alias("id"), F.explode(T.words(F.lower("text"))).alias("w"))
    counts = words.groupBy("id", "w").agg(F.count("*").alias("n")).groupBy("id", bucket(F.col("w"), dimensions).alias("bucket")).agg(F.sum("n").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("value"))


def pseudo_vectors(df: DataFrame, id_column: str = "id", dimensions: int = DIMENSIONS, wide: bool = False) -> DataFrame:
    """id, bucket, value: hashed word counts of each text at length one, one row per bucket in use.

    Buckets follow from 32 bits of a word's hash, or from all 128 (``wide``).
    """
    return _unit_vectors(df, id_column, dimensions, V.wide_bucket if wide else V.bucket).select("id", "bucket", F.round("value", 6).alias("value"))


def tile_vectors(df: DataFrame, dimensions: int = 128) -> DataFrame:
    """id and vector of each tile (id, content): a random direction of length one that follows from the content's hash.

    Equal contents have equal vectors, different ones are nearly at right angles. Null content gives null.
    """

    @F.pandas_udf("array<double>")
    def directions(seeds: pd.Series) -> pd.Series:
        def one(seed):
            if seed is None or pd.isna(seed):
                return None
            v = np.random.default_rng(int(seed)).standard_normal(dimensions)
            return v / np.linalg.norm(v)

        return seeds.map(one)

    seed = F.conv(F.substring(F.sha2("content", 256), 1, 8), 16, 10).cast("bigint")
    return df.select("id", directions(seed).alias("vector"))


def semantic_score(df: DataFrame, key: str = "canonical", dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds semantic to rows with a unique ``key``, query, title, snippet: the cosine of the hashed word
    vectors of the query and of "title. snippet", 0 where they share no bucket.

    An inner product over buckets; its values aren't rounded before the sum, so that four places hold.
    """
    rows = materialise(df)  # read three times
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit("")))
    held = _unit_vectors(rows.select(F.struct(F.col(key).alias("k"), "query").alias("id"), text.alias("text")), "id", dimensions)
    held = held.select("id.k", F.col("id.query").alias("query"), "bucket", "value")
    asked = _unit_vectors(rows.select("query").distinct().select("query", F.col("query").alias("text")), "query", dimensions).select(F.col("id").alias("query"), "bucket", F.col("value").alias("q"))
    near = held.join(asked, ["query", "bucket"]).groupBy("k").agg(F.round(F.least(F.lit(1.0), F.sum(F.col("value") * F.col("q"))), 4).alias("semantic"))
    return rows.join(near, F.col(key) == F.col("k"), "left").drop("k").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def sparse_vectors(df: DataFrame, id_column: str = "id", buckets: int = SPARSE) -> DataFrame:
    """id, bucket, value: 1 + .2 for each further occurrence, half as much again for words with digits or signs."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z0-9_.-]+"), F.lit(0)), lambda t: F.length(t) > 1)
    counts = df.where("text is not null").select(F.col(id_column).alias("id"), F.explode(words).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    value = F.round((1.0 + (F.col("n") - 1) * 0.2) * F.when(F.col("w").rlike("[-_.0-9]"), 1.5).otherwise(1.0), 3)
    return counts.groupBy("id", V.bucket(F.col("w"), buckets).alias("bucket")).agg(F.max(value).alias("value"))


QUERY_BLOCK = 4_096  # queries that go to the tasks together


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """query_id, vec_id, similarity, rank: the nearest vectors of each query by cosine, exactly.

    ``queries`` is a stated set (query_id, embedding; all of one length) against all rows, taken in blocks of about
    QUERY_BLOCK; a block's result is written before the next is read. Each task keeps the best
    ``most`` of its rows for each query of the block, and only these are shuffled.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        one = _nearest_block(vectors, part, most)
        one = one if blocks == 1 else materialise(one)
        found = one if found is None else found.unionByName(one)
    ranked = grouped_positions(found, ["query_id"], [F.desc("similarity"), F.asc("vec_id")], "rank")
    return ranked.where(F.col("rank") < most).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _nearest_block(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    asked = [(r.query_id, r.embedding) for r in queries.where("embedding is not null").select("query_id", "embedding").collect()]  # one block
    names = [q for q, _ in asked]
    matrix = np.array([e for _, e in asked], np.float64) if asked else np.zeros((0, 1))
    norm = np.linalg.norm(matrix, axis=1)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part[part["embedding"].map(lambda e: e is not None and len(e) == matrix.shape[1])]
            if part.empty or not len(matrix):
                continue
            rows = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            for at in range(0, len(rows), 256):
                some, keys = rows[at : at + 256], part["vec_id"].to_numpy()[at : at + 256]
                size = np.outer(norm, np.linalg.norm(some, axis=1))
                near = np.clip(np.divide(matrix @ some.T, size, out=np.zeros_like(size), where=size > 0), 0, 1)
                found = pd.DataFrame({"query_id": np.repeat(names, len(some)), "vec_id": np.tile(keys, len(names)), "similarity": near.ravel()})
                held = found if held is None else pd.concat([held, found])
                held = held.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(most)
        if held is not None:
            yield held

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}["vec_id"]
    key = {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"]
    return vectors.select("vec_id", "embedding").mapInPandas(best, f"query_id {key}, vec_id {kind}, similarity double")


MOST_QUERIES = 10_000  # of a search; their vectors go to every task


class _Hashed:
    """Vectors of texts given as word lists: dense ones (counts by bucket at length one) and sparse ones (weights by bucket)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import hashlib

        if len(self.known) > 500_000:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        return np.array([self.known[w] for w in words], np.int64)

    def _counts(self, lists) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The different words; row, word and count of each pair of a row and a word."""
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        pairs, n = np.unique(rows * max(1, len(words)) + coded.indices.to_numpy(), return_counts=True)
        return words, pairs // max(1, len(words)), pairs % max(1, len(words)), n

    def dense(self, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and value of each bucket in use."""
        words, rows, at, n = self._counts(lists)
        cells, where = np.unique(rows * DIMENSIONS + (self.hashes(words) % DIMENSIONS)[at], return_inverse=True)
        total = np.bincount(where, n, len(cells))
        rows = cells // DIMENSIONS
        norm = np.sqrt(np.bincount(rows, total**2, len(lists)))
        return rows, cells % DIMENSIONS, total / norm[rows]

    def sparse(self, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, rows, at, n = self._counts(lists)
        more = np.array([1.5 if any(c in "-_.0123456789" for c in w) else 1.0 for w in words])
        value = np.round((1 + (n - 1) * 0.2) * more[at], 3) if len(words) else np.zeros(0)
        cells, where = np.unique(rows * SPARSE + (self.hashes(words) % SPARSE)[at], return_inverse=True)
        best = np.zeros(len(cells))
        np.maximum.at(best, where, value)
        return cells // SPARSE, cells % SPARSE, best


def branch_scores(passages: DataFrame, queries: DataFrame, most: int = 60) -> DataFrame:
    """query_id, id, branch, score: dense and sparse matches of queries (query_id, query) among passages (id, text).

    ``queries`` is a short stated list (at most MOST_QUERIES, more are an error) that goes to every
    task; passages are read once where they are, and each task keeps the best ``most`` of its rows for
    each query and branch, so nothing of the passages is shuffled but these.
    """
    lower = F.lower(F.coalesce("text", F.lit("")))
    listed = lambda df, key: df.select(F.col(key), T.words(lower).alias("w"), F.filter(F.regexp_extract_all(lower, F.lit("[a-zA-Z0-9_.-]+"), F.lit(0)), lambda t: F.length(t) > 1).alias("t"))
    asked = listed(queries.select("query_id", F.col("query").alias("text")), "query_id").limit(MOST_QUERIES + 1).toArrow()
    if asked.num_rows > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    names = asked.column("query_id").to_pylist()
    made = _Hashed()
    vectors = {}
    for branch, column in (("dense", "w"), ("sparse", "t")):
        lists = asked.column(column).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        rows, buckets, values = getattr(made, branch)(lists)
        own, at = np.unique(buckets, return_inverse=True)
        table = np.zeros((len(own), len(names)))
        table[at, rows] = values
        vectors[branch] = (own, table)
    shared = passages.sparkSession.sparkContext.broadcast(vectors)
    kind = {f.name: f.dataType.simpleString() for f in passages.schema}["id"]
    key = {f.name: f.dataType.simpleString() for f in queries.schema}["query_id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Hashed()
        held: dict[tuple[str, int], list[tuple[float, object]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_pylist()
                for branch, column in (("dense", 1), ("sparse", 2)):
                    own, table = shared.value[branch]
                    rows, buckets, values = getattr(made, branch)(part.column(column))
                    place = np.searchsorted(own, buckets)
                    hit = (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == buckets) if len(own) else np.zeros(len(buckets), bool)
                    for q in range(table.shape[1] if hit.any() else 0):
                        score = np.bincount(rows[hit], values[hit] * table[place[hit], q], len(ids))
                        found = [(-round(float(score[i]), 4), ids[i]) for i in np.flatnonzero(score)]
                        if found:
                            held[branch, q] = sorted(held.get((branch, q), []) + found)[:most]
        out = [(names[q], i, branch, -s) for (branch, q), rows in held.items() for s, i in rows]
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow)], names=["query_id", "id", "branch", "score"])

    arrow = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(passages.schema["id"].dataType), pa.string(), pa.float64()]
    found = listed(passages, "id").mapInArrow(best, f"query_id {key}, id {kind}, branch string, score double")
    placed = grouped_positions(found, ["query_id", "branch"], [F.desc("score"), F.asc("id")], "_p")
    return placed.where(F.col("_p") < most).select("query_id", "id", "branch", "score")


def search_passages(passages: DataFrame, queries: DataFrame, most: int = 10, per_domain: int = 2) -> DataFrame:
    """query_id, place, id, url, title, rerank_score: search in both branches, fusion, rerank, diverse choice.

    ``passages`` has id, url, title, text, authority_score (repeated ids count once).
    """
    one = passages.groupBy("id").agg(F.min(F.struct("url", "title", "text", "authority_score")).alias("r")).select("id", "r.*")
    fused = fuse(branch_scores(one, queries, 3 * most), {"dense": 0.6, "sparse": 0.4}, most=2 * most).select("query_id", "id", "fusion_score")
    full = materialise(rerank(fused.join(one, "id").join(queries.select("query_id", "query"), "query_id")))
    short = grouped_positions(full, ["query_id"], [F.desc("rerank_score"), F.desc("fusion_score"), F.asc("id")], "place")
    chosen = select_diverse(short.withColumn("score", F.col("rerank_score")), most, per_domain=per_domain)
    return chosen.join(full.select("query_id", "id", "url", "title", "rerank_score"), ["query_id", "id"])
