"""Problem 1: cap the records of dominant contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.urls import host
from tessera.operators.positions import grouped_positions

SALTS = 16  # parts of a query in the join with its limit


def newest_hits(hits: DataFrame) -> DataFrame:
    """One row per id, that with the newest ``retrieved_at`` (null is oldest).

    Rows of one id with the same time are ordered by their values, so the result does not depend on
    the order of the input.
    """
    row = F.struct("query_id", "chunk_id", "url", "score", "authority_score")
    key = F.struct("retrieved_at", "authority_score", "score", "chunk_id", "query_id", "url")
    return hits.groupBy("id").agg(F.max_by(row, key).alias("r")).select("id", "r.*")


def rank_hits(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each hit with its site, its place among the hits of its query from that site, and the limit.

    Columns: query_id, id, site, score, authority_score, place (from 0), cap, kept. The site is the
    host of the chunk's ``source_url``, or of the hit's url where the chunk is unknown; without
    either it is null, and such hits form one site. Authority outside 0 to 1 or null comes last.
    A query without a row or without a limit caps nothing. Null ids form one record; an empty table
    gives an empty result. Extra columns of the inputs are ignored.
    """
    hits = newest_hits(hits.select("id", "query_id", "chunk_id", "url", "score", "authority_score", "retrieved_at"))
    sites = chunks.select("chunk_id", host(F.col("source_url")).alias("site")).groupBy("chunk_id").agg(F.min("site").alias("chunk_site"))
    limits = queries.groupBy("query_id").agg(F.max("max_per_domain").alias("per_domain"), F.max("max_domain_share").alias("share"))
    sized = hits.groupBy("query_id").agg(F.count("*").alias("n")).join(limits, "query_id")
    share = F.greatest(F.floor(F.col("share") * F.col("n")), F.lit(1))
    caps = sized.select("query_id", F.coalesce(F.col("per_domain").cast("long"), share).alias("cap"))
    caps = caps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hits.join(sites, "chunk_id", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    hits = hits.join(caps, ["query_id", "salt"], "left")  # a query with very many hits is joined in parts
    good = F.when(F.col("authority_score").between(0, 1), F.col("authority_score"))
    rows = hits.select("query_id", "id", F.coalesce("chunk_site", host(F.col("url"))).alias("site"), "score", "authority_score", good.alias("good"), "cap")
    order = [F.col("good").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("id").asc_nulls_last()]
    ranked = grouped_positions(rows, ["query_id", "site"], order, "place").drop("good")
    return ranked.withColumn("kept", F.coalesce(F.col("place") < F.col("cap"), F.lit(True)))
