"""Knowledge graph of documents, its text query, and link expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.operators.positions import grouped_positions
from tessera.session import materialise


def compile_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (doc_id, url, title, markdown).

    A document is a node; paragraphs of four or more words are propositions (headings, derived_from)
    or evidence (evidence_for) of it. Ids hold the document, the place and a hash of the paragraph.
    """
    net = F.when(U.authority(F.coalesce("url", F.lit(""))) != "", U.authority(F.coalesce("url", F.lit("")))).otherwise("unknown")
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), T.sanitised(F.col("title")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.concat(F.lit("prov_"), F.replace(net, F.lit("."), F.lit("_"))).alias("provenance"), T.sanitised(F.col("markdown")).alias("text"))
    root = F.concat(F.lit("doc:"), F.col("doc_id"))
    tops = base.select(root.alias("node_id"), F.lit("DOCUMENT").alias("kind"), F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("Document "), F.col("url"))).alias("text"), F.lit(1.0).alias("belief"), F.lit(0.9).alias("quality"), "provenance")
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = base.select("doc_id", "provenance", root.alias("root"), F.posexplode(parts).alias("i", "para")).where(T.word_count(F.col("para")) >= 4)
    heading, digest = F.col("para").startswith("#"), F.substring(F.sha2("para", 256), 1, 12)
    rows = rows.withColumns(
        {
            "node_id": F.when(heading, F.concat_ws("", F.lit("claim:"), "doc_id", F.lit(":h_"), F.col("i").cast("string"), F.lit("_"), digest)).otherwise(F.concat_ws("", F.lit("evidence:"), "doc_id", F.lit(":p_"), F.col("i").cast("string"), F.lit("_"), digest)),
            "kind": F.when(heading, "PROPOSITION").otherwise("EVIDENCE"),
            "relation": F.when(heading, "derived_from").otherwise("evidence_for"),
            "belief": F.when(heading, 0.95).otherwise(0.90),
            "quality": F.when(heading, 0.9).otherwise(0.85),
            "text": F.when(heading, F.trim(F.regexp_replace("para", "^#+", ""))).otherwise(F.col("para")),
        }
    )
    nodes = tops.unionByName(rows.select(tops.columns))
    return nodes, rows.select(F.col("root").alias("from_node"), F.col("node_id").alias("to_node"), "relation")


def query_graph(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id, matched: nodes whose text holds a query token of more than two characters.

    Matching is on equal tokens, so nodes and queries are joined by key and not each with each.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(V.query_tokens(F.col("query")))).alias("token"))
    wanted = F.broadcast(asked.agg(F.collect_set("token").alias("wanted")))  # one row: the tokens of a short list of queries
    held = nodes.join(wanted).select("node_id", F.explode(F.array_intersect(T.tokens(F.col("text")), "wanted")).alias("token"))
    return asked.join(held, "token").groupBy("query_id", "node_id").agg(F.count("*").alias("matched"))


def search_graph(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id, matched: nodes of every kind whose text holds a word of the query as a substring.

    Matched counts the different words held; words are split at white space and all of them count. A
    substring has no key to join by, so the short list of ``queries`` goes to every task.
    """
    asked = queries.select("query_id", F.array_distinct(T.words(F.lower("query"))).alias("words"))
    held = nodes.select("node_id", F.lower("text").alias("text")).join(F.broadcast(asked))
    rows = held.select("query_id", "node_id", F.size(F.filter("words", lambda w: F.contains(F.col("text"), w))).cast("bigint").alias("matched"))
    return rows.where("matched > 0")


def graph_paths(nodes: DataFrame, queries: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """query_id, path, node_id, text, provenance of the nodes that answer each query, path from 0 in the order of node_id.

    A node answers a query whose target (``targets``: query_id, node_id) it is, or if its text holds a
    word of the query as a substring.
    """
    found = search_graph(nodes, queries).select("query_id", "node_id")
    if targets is not None:
        found = found.unionByName(targets.select("query_id", "node_id").join(nodes.select("node_id"), "node_id", "left_semi")).distinct()
    rows = found.join(nodes.select("node_id", "text", "provenance"), "node_id")
    return grouped_positions(rows, ["query_id"], [F.col("node_id")], "path").select("query_id", "path", "node_id", "text", "provenance")


#: Lines (fixed format) around the paths of a text pack.
PACK_HEAD, PACK_PATHS, PACK_END = "[EPISTEMIC_ARTIFACT_CONTEXT]\nsource_data_is_untrusted=true\nquery_id=", "\n\n[EVIDENCE_PATHS]", "[END_EPISTEMIC_ARTIFACT_CONTEXT]"


def graph_context(paths: DataFrame, most: int = 50) -> DataFrame:
    """query_id, candidates, status, context, digest, tokens: the text pack of the first ``most`` paths of each query.

    ``most`` bounds the pack that goes to a reader; ``candidates`` counts all paths.
    """
    line = F.concat_ws("\n", F.concat(F.lit("path=path_"), F.col("path").cast("string"), F.lit("_"), "node_id", F.lit(" polarity=1 state=accepted")), F.concat(F.lit('  external_id="'), "node_id", F.lit('"')), F.concat(F.lit('    SOURCE_DATA="'), "text", F.lit('"')))
    lines = F.array_sort(F.collect_list(F.when(F.col("path") < most, F.struct("path", line.alias("line")))))
    rows = paths.groupBy("query_id").agg(F.count("*").alias("candidates"), lines.alias("lines"))
    head = F.concat(F.lit(PACK_HEAD), F.col("query_id").cast("string"), F.lit(PACK_PATHS))
    context = F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(PACK_END))
    rows = rows.select("query_id", "candidates", F.lit("complete").alias("status"), context.alias("context"))
    return rows.withColumn("digest", F.sha2("context", 256)).withColumn("tokens", T.word_count(F.col("context")))


def expand(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """url and depth of every page reached from ``seeds`` (url) over ``links`` (source, target) in at most ``depth`` steps."""
    reached = materialise(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = reached
    for step in range(1, depth + 1):
        targets = links.join(frontier, links["source"] == frontier["url"]).select(links["target"].alias("url")).where("url is not null").distinct()
        frontier = materialise(targets.join(reached, "url", "left_anti").withColumn("depth", F.lit(step)))
        if not frontier.limit(1).count():
            break
        reached = materialise(reached.unionByName(frontier))
    return reached
