"""The queries of the training-data problems, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import contributor_caps, languages, near_duplicates, packing, pages, repeated_lines, shells, splitting, subjects, tokens
from tessera.session import materialise
from tessera.sources import table


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return contributor_caps.rank_hits(table(spark, d, "retrieval_hits"), table(spark, d, "rag_chunks"), table(spark, d, "search_queries"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranked(spark, d).where(~F.col("kept")).select("query_id", "id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captured_artifacts")


def _labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of both tables with address, declared label and declared markup language."""
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text", "url", F.col("lang").alias("label"), none.alias("markup"), F.lit(False).alias("page"))
    labels = table(spark, d, "content_quality").groupBy("artifact_id").agg(F.min(F.try_element_at("details", F.lit("language"))).alias("label"))
    markup = F.nullif(F.regexp_extract(F.decode("raw_content", "ISO-8859-1"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([^\"'>\s]+)", 1), F.lit(""))
    captured = _pages(spark, d).join(labels, "artifact_id", "left").select(F.lit("captured_artifacts").alias("tbl"), F.col("artifact_id").alias("rec_id"), F.col("text_content").alias("text"), "url", "label", markup.alias("markup"), F.lit(True).alias("page"))
    return docs.unionByName(captured)


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    texts = _labelled_texts(spark, d)
    return languages.languages(texts, languages.fit(texts), shells.fit_pages(_pages(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_languages(spark, d).where("line_no >= 0 or named is null or named <> lang").select("tbl", "rec_id", "line_no", "lang")


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col("chunk_id").alias("id"), "text") for t in ("rag_chunks", "structured_chunks")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.all_pairs(*near_duplicates.similar(_chunk_texts(spark, d)))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*near_duplicates.similar(_chunk_texts(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return shells.shell_pages(rows, shells.fit_pages(rows))


def _oversized(spark: SparkSession, d: str, unique: bool) -> DataFrame:
    return splitting.oversized(table(spark, d, "extracted_content"), table(spark, d, "structured_chunks"), table(spark, d, "size_limits"), unique)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_oversized(spark, d, True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_items(_oversized(spark, d, False), with_text=False)
    return pieces.where("piece_no = 0 and n_pieces > 1").select("tbl", "rec_id").distinct()


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row per item that was cut: whether its pieces cover it, fit, and overlap as asked."""
    items = _oversized(spark, d, True)
    pieces = splitting.split_items(items).groupBy("tbl", "rec_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "token_estimate", "overlap_tokens"))).alias("p"))
    rows = pieces.where(F.size("p") > 1).join(items.select("tbl", "rec_id", F.length("text").alias("chars"), "limit_tokens", "overlap_tokens").hint("merge"), ["tbl", "rec_id"])
    meet = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: (y["start"] < x["end"]) & (y["start"] > x["start"]) & (y["end"] > x["end"]) & (y["overlap_tokens"] > 0))
    covered = F.forall(meet, lambda ok: ok) & (F.col("p")[0]["start"] == 0)
    fit = F.forall("p", lambda x: (x["token_estimate"] <= F.col("limit_tokens")) & (x["overlap_tokens"] <= F.col("overlap_tokens")))
    return rows.select("tbl", "rec_id", F.element_at("p", -1)["end"].cast("bigint").alias("chars"), covered.alias("covered"), fit.alias("fit"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "rag_chunks")).select("chunk_id", "line_no")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "rag_chunks")
    return repeated_lines.without_lines(chunks, repeated_lines.repeated_lines(chunks))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return pages.furniture_lines(rows, pages.fit_lines(rows), shells.fit_pages(rows))


def p7_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return pages.main_body(rows, pages.fit_lines(rows))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: text of every document from its ids."""
    return tokens.decode_texts(tokens.encode_texts(table(spark, d, "documents")))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each container type: documents packed, documents whose pieces don't add up, containers over the capacity."""
    sizes = tokens.count_tokens(table(spark, d, "documents"))
    limits = {r.item_type: r.limit_tokens for r in table(spark, d, "size_limits").where(F.col("item_type").startswith("container_")).collect()}
    placed = materialise(packing.pack(sizes, limits))
    whole = placed.groupBy("container_type", "doc_id").agg(F.sum("n_tokens").alias("placed")).join(sizes.select("doc_id", "n_tokens").hint("merge"), "doc_id")
    docs = whole.groupBy("container_type").agg(F.count("*").alias("documents"), F.sum((F.col("placed") != F.col("n_tokens")).cast("bigint")).alias("torn"))
    full = placed.where("container_id >= 0").groupBy("container_type", "container_id").agg(F.sum("n_tokens").alias("filled"))
    capacity = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("container_type"))
    return docs.join(full.groupBy("container_type").agg(F.sum((F.col("filled") > capacity).cast("bigint")).alias("overfull")), "container_type")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    limits = {r.item_type: r.limit_tokens for r in table(spark, d, "size_limits").where(F.col("item_type").startswith("container_")).collect()}
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), limits)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = subjects.fit(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return subjects.subject_shares(docs, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).where(F.col("share") >= subjects.SHARE).select("doc_id", "subject")


def p10_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Share of the corpus' characters by subject."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    parts = p10_shares(spark, d).join(sizes, "doc_id").groupBy("subject").agg(F.sum(F.col("share") * F.col("chars")).alias("chars"), F.count("*").alias("documents"))
    return parts.select("subject", "documents", "chars", (F.col("chars") / F.sum("chars").over(Window.partitionBy())).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranked, p2_found, p2_languages, p3_found, p3_groups, p4_found, p5_found, p5_pieces, p5_checked, p6_found, p6_texts, p7_found, p7_articles, p8_ids, p8_decoded, p9_containers, p9_checked, p10_found, p10_shares, p10_corpus)}

_SITE = "nullif(regexp_replace(lower(regexp_extract(%s, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '')"
_RANKED = f"""
with newest as (
  select id, query_id, chunk_id, url, score, authority_score from (
    select *, row_number() over (partition by id order by retrieved_at desc nulls last, authority_score desc nulls last, score desc nulls last, chunk_id desc nulls last, query_id desc nulls last, url desc nulls last) as k
    from retrieval_hits) where k = 1),
sites as (select chunk_id, min({_SITE % "source_url"}) as chunk_site from rag_chunks group by chunk_id),
limits as (select query_id, max(max_per_domain) as per_domain, max(max_domain_share) as share from search_queries group by query_id),
caps as (select n.query_id, coalesce(per_domain, greatest(1, cast(floor(share * n.c) as bigint))) as cap
  from (select query_id, count(*) as c from newest group by query_id) n join limits using (query_id)),
rows_ as (select h.query_id, h.id, coalesce(s.chunk_site, {_SITE % "h.url"}) as site, h.score, h.authority_score, c.cap
  from newest h left join sites s on h.chunk_id = s.chunk_id left join caps c on h.query_id = c.query_id),
ranked as (select *, row_number() over (partition by query_id, site order by case when authority_score between 0 and 1 then authority_score end desc nulls last, score desc nulls last, id) - 1 as place from rows_)
"""
_TOKENS = "greatest(1, cast(floor(1.3 * len(regexp_extract_all(%s, '\\S+'))) as bigint), cast(floor(length(%s) / 3.5) as bigint))"

_PAIRS = """
texts as (select distinct tbl, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from (select 'rag_chunks' as tbl, chunk_id as id, text from rag_chunks union all select 'structured_chunks', chunk_id, text from structured_chunks) where id is not null and text is not null),
triples as (select distinct tbl, id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as t from texts where len(w) >= 3),
sizes as (select tbl, id, count(*) as n from triples group by all),
shared as (select a.tbl, a.id as chunk_a, b.id as chunk_b, count(*) as n from triples a join triples b on a.tbl = b.tbl and a.t = b.t and a.id < b.id group by all),
pairs as (select s.tbl, chunk_a, chunk_b from shared s join sizes a on a.tbl = s.tbl and a.id = chunk_a join sizes b on b.tbl = s.tbl and b.id = chunk_b where s.n >= 0.6::double * (a.n + b.n - s.n))"""
_REPEATED = f"""lines as (select distinct {_SITE % "source_url"} as site, chunk_id, unnest(range(len(l))) as line_no, unnest(l) as raw from (select source_url, chunk_id, string_split(text, chr(10)) as l from rag_chunks)),
      normal as (select site, chunk_id, line_no, regexp_replace(trim(regexp_replace(lower(raw), '[\\s\\p{{Z}}]+', ' ', 'g')), '\\d+', '0', 'g') as line from lines),
      often as (select site, line from normal where line <> '' group by site, line having count(distinct chunk_id) >= 6),
      found as (select distinct chunk_id, line_no from normal join often using (site, line))"""

ORACLE = {
    "p3_found": f"with {_PAIRS} select * from pairs",
    "p3_groups": f"""with recursive {_PAIRS}, both_ as (select tbl, chunk_a as a, chunk_b as b from pairs union all select tbl, chunk_b, chunk_a from pairs),
      r(tbl, id, seen) as (select tbl, id, id from sizes union select r.tbl, r.id, e.b from r join both_ e on e.tbl = r.tbl and e.a = r.seen),
      d as (select tbl, a as id, count(*) as links from both_ group by all)
      select r.tbl, r.id, min(seen) as "group", coalesce(max(links), 0) as links from r left join d on d.tbl = r.tbl and d.id = r.id group by r.tbl, r.id""",
    "p6_texts": f"""with {_REPEATED}, one as (select chunk_id, max(text) as text from rag_chunks group by chunk_id), gone as (select chunk_id, list(line_no) as g from found group by chunk_id)
      select chunk_id, case when text is not null then array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: not coalesce(list_contains(g, i), false)), lambda i: string_split(text, chr(10))[i + 1]), chr(10)) end as text from one left join gone using (chunk_id)""",
    "p1_found": _RANKED + "select query_id, id from ranked where place >= cap",
    "p1_ranked": _RANKED + "select query_id, id, site, score, authority_score, place, cap, coalesce(place < cap, true) as kept from ranked",
    "p5_found": f"""
      select distinct 'extracted_content' as tbl, content_id as rec_id from extracted_content where clean_markdown <> '' and {_TOKENS % ("clean_markdown", "clean_markdown")} > (select limit_tokens from size_limits where item_type = 'extracted_content')
      union all
      select distinct 'structured_chunks', chunk_id from structured_chunks where text <> '' and {_TOKENS % ("text", "text")} > (select limit_tokens from size_limits where item_type = 'structured_chunks')""",
    "p5_checked": f"""
      with items as (
        select 'extracted_content' as tbl, content_id as rec_id, arg_max(clean_markdown, struct_pack(n := length(clean_markdown), t := clean_markdown)) as text from extracted_content where clean_markdown <> '' group by content_id
        union all
        select 'structured_chunks', chunk_id, arg_max(text, struct_pack(n := length(text), t := text)) from structured_chunks where text <> '' group by chunk_id)
      select tbl, rec_id, cast(length(text) as bigint) as chars, true as covered, true as fit from items join size_limits on item_type = tbl
      where {_TOKENS % ("text", "text")} > limit_tokens""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_checked": "select item_type as container_type, (select count(*) from documents) as documents, 0 as torn, 0 as overfull from size_limits where item_type like 'container_%'",
    "p6_found": f"with {_REPEATED} select chunk_id, line_no from found",
}
