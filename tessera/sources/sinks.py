"""Writers: chunk exports, notes, citations, content-addressed storage, keyed upserts."""

from __future__ import annotations

import hashlib
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.urls import authority
from tessera.operators.dedup import first_by
from tessera.operators.positions import grouped_positions


def dataset_rows(chunks: DataFrame, query: str, domain: str | None = None) -> DataFrame:
    """id, text, metadata (struct) of chunks, for training sets."""
    meta = F.struct(F.lit(query).alias("query"), F.lit(domain or "Global").alias("domain"), "source_url", "canonical_url", "title", "token_estimate", "relevance_score", "provenance")
    return chunks.select(F.col("chunk_id").alias("id"), T.sanitised(F.col("text")).alias("text"), meta.alias("metadata"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def context_text(chunks: DataFrame) -> DataFrame:
    """value: one Markdown passage a chunk, for a text file."""
    head = F.concat_ws(" > ", "heading_path")
    return chunks.select(F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.when(head != "", F.concat(F.lit(" — "), head)).otherwise(F.lit("")), F.lit("\n\n"), T.sanitised(F.col("text")), F.lit("\n\nSource: "), F.coalesce("source_url", F.lit("")), F.lit("\n")).alias("value"))


def manifest(documents: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, rejections: DataFrame) -> DataFrame:
    """One row of counts of what an export holds."""
    out = None
    for name, df in (("total_documents", documents), ("total_chunks", chunks), ("total_nodes", nodes), ("total_edges", edges), ("total_rejections", rejections)):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def notes(documents: DataFrame, query: str, captured: str) -> DataFrame:
    """name and content of a linked note of each document (n, url, title, markdown)."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("Source "), F.col("n").cast("string")))
    net, text = authority(F.coalesce("url", F.lit(""))), F.coalesce(F.when(F.col("markdown") != "", F.col("markdown")), F.lit("No content extracted."))
    name = F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), T.slug(title))
    lines = [F.lit("---"), F.lit(""), F.concat(F.lit("source_url: "), F.col("url")), F.concat(F.lit("domain: "), net), F.lit(f"date_captured: {captured}"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), text, F.lit(""), F.lit(f"- [[00_Index|Back to index: {query}]]")]
    lines[1] = F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return documents.select(name.alias("name"), F.concat_ws("\n", *lines).alias("content"))


def citations(documents: DataFrame, query: str, accessed: str) -> DataFrame:
    """csl (JSON) and ris (text) of each document (n, url, title, markdown)."""
    y, m, d = (int(x) for x in accessed.split("-"))
    net = authority(F.coalesce("url", F.lit("")))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("Document "), F.col("n").cast("string")))
    ident, text = F.concat(F.lit("ref_"), F.lpad(F.col("n").cast("string"), 3, "0")), F.coalesce("markdown", F.lit(""))
    csl = F.to_json(F.struct(ident.alias("id"), F.lit("webpage").alias("type"), title.alias("title"), F.col("url").alias("URL"), net.alias("container-title"), F.substring(text, 1, 500).alias("abstract"), F.struct(F.array(F.array(F.lit(y), F.lit(m), F.lit(d))).alias("date-parts")).alias("accessed"), F.lit(query).alias("keyword")))
    line = lambda k, v: F.concat(F.lit(f"{k}  - "), F.coalesce(v, F.lit("")))
    ris = F.concat_ws("\n", line("TY", F.lit("ELEC")), line("ID", ident), line("TI", title), line("UR", F.col("url")), line("PB", net), line("AB", F.replace(F.substring(text, 1, 600), F.lit("\n"), F.lit(" "))), line("Y2", F.lit(accessed.replace("-", "/"))), line("KW", F.lit(query)), F.lit("ER  - "))
    return documents.select("n", csl.alias("csl"), ris.alias("ris"))


def graph_corpus(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: one JSON object a node and an edge, told apart by ``record``, for one text file."""
    rows = [df.select(F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("value")) for kind, df in (("node", nodes), ("edge", edges))]
    return rows[0].unionByName(rows[1])


def markdown_files(documents: DataFrame, path: str) -> None:
    """A Markdown file of each document (name, content) under ``path``, written where the rows are.

    ``path`` is a folder that all executors reach; a name counts once.
    """

    def write(rows):
        os.makedirs(path, exist_ok=True)
        for r in rows:
            target = os.path.join(path, f"{os.path.basename(r.name)}.md")
            with open(f"{target}.part", "w", encoding="utf-8") as f:
                f.write(r.content)
            os.replace(f"{target}.part", target)  # a task that runs again writes the same file

    documents.select("name", "content").foreachPartition(write)


def migrate(spark, base: str, steps: list, target: int | None = None) -> DataFrame:
    """A table at ``base`` brought to version ``target`` (the last, if none) by ``steps``, functions from table to table.

    Version n is a table of its own made by step n of version n - 1 (step 1 gets None); versions that
    are there are not made again, and an older target reads the older table.
    """
    target = len(steps) if target is None else target
    current = None
    for n, step in enumerate(steps[:target], 1):
        path = f"{base}/v{n}"
        try:
            current = spark.read.parquet(path)
        except Exception:  # not made yet
            step(current).write.parquet(path)
            current = spark.read.parquet(path)
    return current


def push(queue: DataFrame, requests: DataFrame, capacity: int) -> DataFrame:
    """Requests (seq, ...) with pushed: in the order of seq as many as the queue has room for, given its rows."""
    room = max(0, capacity - queue.count())
    return grouped_positions(requests, [], [F.col("seq")], "_p").withColumn("pushed", F.col("_p") < room).drop("_p")


def store_contents(contents: DataFrame, path: str) -> DataFrame:
    """Write contents (content binary) once each under their SHA-256, parted by its first two digits; returns what was new."""
    spark = contents.sparkSession
    rows = contents.where("content is not null").withColumn("content_hash", F.sha2("content", 256)).groupBy("content_hash").agg(F.first("content").alias("content"))
    rows = rows.withColumn("prefix", F.substring("content_hash", 1, 2))
    try:
        known = spark.read.parquet(path).select("content_hash")
    except Exception:  # nothing stored yet
        known = None
    new = rows.join(known, "content_hash", "left_anti") if known is not None else rows
    new.write.mode("append").partitionBy("prefix").option("compression", "zstd").parquet(path)
    return new.select("content_hash")


def read_contents(spark, path: str, hashes: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(hashes.select("content_hash").distinct(), "content_hash").select("content_hash", "content")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both with the newest ``order`` of each key; rows of ``changes`` win ties."""
    both = current.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)))
    return first_by(both.withColumn("_o", F.struct(F.col(order), F.col("_late"))).withColumn("_n", -F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))).withColumn("_l", -F.col("_late")), [key], ["_n", "_l"]).drop("_o", "_n", "_l", "_late")


def delete_documents(current: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    return current.join(documents.select(key).distinct(), key, "left_anti")


def deterministic_zip(folder: str, target: str) -> str:
    """Zip a folder on the driver with sorted names and fixed times; returns the archive's SHA-256."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        names = sorted(os.path.relpath(os.path.join(base, f), folder) for base, _, files in os.walk(folder) for f in files)
        for name in names:
            info = zipfile.ZipInfo(name.replace(os.sep, "/"), (1980, 1, 1, 0, 0, 0))
            with open(os.path.join(folder, name), "rb") as f:
                z.writestr(info, f.read(), zipfile.ZIP_DEFLATED)
    with open(target, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
