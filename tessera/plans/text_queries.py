"""Queries over texts: sizes, hashes, duplicates, filters, chunks, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, classify, dedup, graphs, retrieval
from tessera.plans import sql as S
from tessera.sources import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", T.word_count(text).cast("bigint").alias("words"), T.token_estimate(text).alias("tokens"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("source", F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("source", "token").agg(F.count("*").alias("n"))


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.sanitised(text)).alias("sanitised"), F.md5(T.useful_text(text)).alias("useful"), T.slug(F.substring(text, 1, 60)).alias("slug"), T.content_hash(text).alias("content_hash"))


def markdown_cleaning(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_content").select("content_id", T.clean_markdown(F.col("clean_markdown")).alias("clean")).distinct()
    return rows.select("content_id", F.md5("clean").alias("clean"), F.md5(T.fit_markdown(F.col("clean"))).alias("fit"))


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where("text is not null")
    return rows.select("doc_id", F.posexplode(F.slice(T.sentences(F.col("text"), 30), 1, 3)).alias("ordinal", "sentence"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(_docs(spark, d))


def simhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.simhash(_docs(spark, d))


def shingle_simhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shingle_simhash(_docs(spark, d))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_pairs(dedup.simhash(_docs(spark, d)))


def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(dedup.simhash(_docs(spark, d)))


def near_dup_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.near_matches(dedup.simhash(_docs(spark, d)))
    return rows.agg(F.count("*").alias("documents"), F.count("near_dup_of").alias("near_duplicates"), F.round(F.count("near_dup_of") / F.count("*"), 6).alias("ratio"))


def near_dup_12(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours up to a Hamming distance of 12, of pairs of words."""
    return dedup.near_matches(dedup.shingle_simhash(_docs(spark, d)), 12)


def document_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.document_dedup(_docs(spark, d))


def content_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = classify.inspect_content(_docs(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "is_valid", F.round("main_text_ratio", 6).alias("main_text_ratio"), "link_density", "is_spam", "is_navigation_only", "rejection_reason")


def content_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "text", F.col("n_chars").alias("raw_chars"))
    return classify.content_quality(rows).select("doc_id", "decision", "overall_score", "text_density", "is_challenge_or_shell")


def document_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Each research document against the query that its number picks from a fixed set."""
    asked = F.array(*[F.lit(q) for q in S.QUERIES])
    pick = lambda a: F.element_at(a, (F.pmod("doc_id", F.lit(len(S.QUERIES))) + 1).cast("int"))
    rows = _docs(spark, d).select("doc_id", "text", F.split("text", "\n")[0].alias("title"), pick(asked).alias("query"), F.array(pick(F.array(*[F.lit(e) for e in S.ENTITIES]))).alias("entities"))
    return classify.relevance(rows).select("doc_id", "relevance", "tier", "accepted")


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(_docs(spark, d).select(F.col("doc_id").alias("document_id"), F.col("text").alias("markdown")))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_content").select(F.col("content_id").alias("document_id"), F.lit("").alias("title"), F.col("clean_markdown").alias("markdown"))
    return dedup.first_by(rows, ["document_id"], ["markdown"])


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.linked(chunking.chunk_documents(_markdown(spark, d), 200, nested=True))


def bounded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.linked(chunking.chunk_documents(_markdown(spark, d), 250, nested=False, strict=True))


def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_vectors(_docs(spark, d), "doc_id")


def pseudo_vectors(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pseudo_vectors(_docs(spark, d), "doc_id")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def cosine_centre(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to the mean of its label."""
    vectors = table(spark, d, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.round(F.col("v").cast("double"), 6)).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # 64 numbers a label
    return vectors.join(centres, "label").select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("centre")), 4).alias("similarity"))


def _graph(spark: SparkSession, d: str):
    rows = _docs(spark, d).where("text is not null").select("doc_id", "url", F.split("text", "\n")[0].alias("title"), F.col("text").alias("markdown"))
    return graphs.compile_graph(rows)


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].select("node_id", "kind", F.md5("text").alias("text"), "belief", "quality", "provenance")


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def kg_query(spark: SparkSession, d: str) -> DataFrame:
    """First lines only and by equal tokens, as its SQL has it; ``kg_search`` searches all nodes."""
    asked = spark.createDataFrame(list(enumerate(S.QUERIES)), "query_id int, query string")
    return graphs.query_graph(_graph(spark, d)[0].where("kind = 'DOCUMENT'"), asked)


def kg_search(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(S.QUERIES)), "query_id int, query string")
    return graphs.search_graph(_graph(spark, d)[0], asked)


QUERIES = {f.__name__: f for f in (token_estimate, token_counts, text_cleaning, markdown_cleaning, sentence_rows, exact_dedup, simhash, shingle_simhash, near_dup_pairs, near_dup_clusters, near_dup_ratio, near_dup_12, document_dedup, content_filter, content_quality, document_relevance, paragraph_chunks, structured_chunks, bounded_chunks, sparse_vectors, pseudo_vectors, cosine_topk, cosine_centre, kg_nodes, kg_edges, kg_query, kg_search)}

_SIM = S.simhash("documents", "doc_id", S.tokens("text"))
_PAIRS = f"select a.id as id_a, b.id as id_b, bit_count(xor(a.u, b.u)) as distance from ({_SIM}) a join ({_SIM}) b on a.id < b.id and a.u <> 0 and b.u <> 0 and bit_count(xor(a.u, b.u)) <= 3"

_SHINGLES = S.simhash("documents", "doc_id", "case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end", f"(select *, list_filter({S.tokens('text')}, lambda t: length(t) > 1) as w from documents)")

_NODES = f"""b as (select doc_id::varchar as doc_id, {S.sanitised("string_split(text, chr(10))[1]")} as title, coalesce(url, '') as url, 'prov_' || replace(case when {S.authority("coalesce(url, '')")} <> '' then {S.authority("coalesce(url, '')")} else 'unknown' end, '.', '_') as provenance, {S.sanitised("text")} as t from documents where text is not null),
    p as (select doc_id, provenance, unnest(l) as q, unnest(range(len(l))) as i from (select *, list_filter(list_transform(string_split_regex(t, '\\n[\\s\\x0B]*\\n'), lambda x: {S.trimmed_ascii("x")}), lambda x: x <> '') as l from b)),
    r as (select *, starts_with(q, '#') as head, substr(sha256(q), 1, 12) as digest from p where {S.word_count("q")} >= 4),
    e as (select *, case when head then 'claim:' || doc_id || ':h_' else 'evidence:' || doc_id || ':p_' end || i || '_' || digest as node_id from r),
    nodes as (select 'doc:' || doc_id as node_id, 'DOCUMENT' as kind, case when title <> '' then title else 'Document ' || url end as text, 1.0::double as belief, 0.9::double as quality, provenance from b
      union all select node_id, case when head then 'PROPOSITION' else 'EVIDENCE' end, case when head then regexp_replace(regexp_replace(q, '^#+', ''), '^ +| +$', '', 'g') else q end, case when head then 0.95 else 0.90 end, case when head then 0.9 else 0.85 end, provenance from e)"""
_CLEAN = r"regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(replace(coalesce(clean_markdown, ''), chr(160), ' '), '\r\n|\n|\r'), lambda s: regexp_replace(s, '^[ \t]+|[ \t]+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_TRIM = "regexp_replace(s, '^ +| +$', '', 'g')"


def _stem(token: str, text: str) -> str:
    stem = f"case when length({token}) >= 6 then substr({token}, 1, length({token}) - 2) else substr({token}, 1, length({token}) - 1) end"
    return f"(contains({text}, {token}) or (length({token}) >= 4 and length({stem}) >= 3 and contains({text}, {stem})))"


ORACLE = {
    "markdown_cleaning": f"""with c as (select distinct content_id, {_CLEAN} as clean from extracted_content)
        select content_id, md5(clean) as clean, md5(array_to_string(list_filter(string_split(clean, chr(10)), lambda s: not (regexp_matches({_TRIM}, '^[*\\-]?[\\s\\x0B]*\\[[^\\]]*\\]\\((/|#)[^)]*\\)$') and length({_TRIM}) < 35)), chr(10))) as fit from c""",
    "kg_nodes": f"with {_NODES} select node_id, kind, md5(text) as text, belief, quality, provenance from nodes",
    "kg_edges": f"with {_NODES} select 'doc:' || doc_id as from_node, node_id as to_node, case when head then 'derived_from' else 'evidence_for' end as relation from e",
    "kg_search": f"""with {_NODES}, q as (select query_id, list_distinct(string_split(lower(query), ' ')) as words from (values {", ".join(f"({i}, '{q}')" for i, q in enumerate(S.QUERIES))}) v(query_id, query))
        select * from (select query_id, node_id, len(list_filter(words, lambda w: contains(lower(text), w))) as matched from nodes cross join q) where matched > 0""",
    "cosine_centre": """with p as (select label, i, avg(round(v::double, 6)) as m from (select label, unnest(embedding) as v, unnest(range(len(embedding))) as i from embeddings) group by all), c as (select label, list(m order by i) as centre from p group by label)
        select vec_id, label, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: x::double), centre))), 4) as similarity from embeddings join c using (label)""",
    "document_relevance": f"""with d as (select doc_id, lower(coalesce(text, '')) as text, lower(coalesce(string_split(text, chr(10))[1], '')) as title, {S.tokens(f"[{S.quoted(S.QUERIES)}][doc_id % {len(S.QUERIES)} + 1]")} as q, lower([{S.quoted(S.ENTITIES)}][doc_id % {len(S.QUERIES)} + 1]) as e from documents),
        a as (select *, list_filter(q, lambda t: length(t) > 2) as asked from d),
        s as (select *, len(list_filter(asked, lambda t: {_stem("t", "text")})) / greatest(len(asked), 1) as cov, least(0.15::double, 0.05::double * len(list_filter(asked, lambda t: {_stem("t", "title")}))) as bonus, cast({_stem("e", "text")} or {_stem("e", "title")} as int) as ent,
          0.5::double + case when len(list_filter(regexp_extract_all(text, '\\d+\\.\\d+|[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^\\d+(\\.\\d+)?$'))) > 3 then 0.25 else 0 end + case when {S.any_of("text", classify.EVIDENCE_MARKERS)} then 0.25 else 0 end as dense from a),
        r as (select doc_id, case when length({S.trimmed("text")}) < 50 then 0.0::double else least(1.0::double, round(0.45::double * cov + 0.35::double * ent + 0.15::double * dense + 0.05::double * (bonus / 0.15::double), 4)) end as relevance from s)
        select doc_id, relevance, case when relevance >= 0.65 then 'HIGH' when relevance >= 0.35 then 'MEDIUM' when relevance >= 0.15 then 'LOW' else 'OFF_TOPIC' end as tier, relevance >= 0.15 as accepted from r""",
    "near_dup_12": f"""with s as ({_SHINGLES}), p as (select a.id as x, b.id as y from s a join s b on a.id < b.id and a.u <> 0 and b.u <> 0 and bit_count(xor(a.u, b.u)) <= 12),
        e as (select x as id, y as other from p union all select y, x from p)
        select s.id, count(other) as n_near, case when min(other) < s.id then min(other) end as near_dup_of from s left join e on s.id = e.id group by s.id""",
    "near_dup_clusters": f"""with recursive s as (select id from ({_SIM})), p as ({_PAIRS}), e as (select id_a as x, id_b as y from p union all select id_b, id_a from p),
        r(id, seen) as (select id, id from s union select r.id, e.y from r join e on r.seen = e.x)
        select id, min(seen) as cluster from r group by id""",
    "token_estimate": f"select doc_id, {S.word_count('text')} as words, {S.token_estimate('text')} as tokens from documents",
    "token_counts": f"select source, token, count(*) as n from (select source, unnest({S.tokens('text')}) as token from documents) group by source, token",
    "text_cleaning": f"""select doc_id, md5({S.sanitised('text')}) as sanitised, md5({S.useful('text')}) as useful,
        regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
        sha256(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'))) as content_hash from documents""",
    "sentence_rows": f"""select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) as ordinal, s as sentence from (
        select doc_id, k, s, row_number() over (partition by doc_id order by k) as n from (
          select doc_id, unnest(range(len(l))) as k, {S.trimmed('unnest(l)')} as s from (select doc_id, string_split(regexp_replace(text, '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g'), chr(1)) as l from documents where text is not null)) where length(s) > 30) where n <= 3""",
    "exact_dedup": "select doc_id as id, sha256(text) as content_hash, min(doc_id) over (partition by text) as first_id, doc_id > min(doc_id) over (partition by text) as is_duplicate from documents where text is not null",
    "simhash": f"select id, fingerprint from ({_SIM})",
    "shingle_simhash": f"select id, fingerprint from ({_SHINGLES})",
    "near_dup_pairs": _PAIRS,
    "near_dup_ratio": f"with s as (select id from ({_SIM})), p as ({_PAIRS}) select count(*) as documents, count(o) as near_duplicates, round(count(o) / count(*), 6) as ratio from (select s.id, (select min(id_a) from p where p.id_b = s.id) as o from s)",
    "document_dedup": f"""with e as (select doc_id, text, doc_id > min(doc_id) over (partition by text) as dup from documents where text is not null),
        s as ({S.simhash('e', 'doc_id', S.tokens('text'), '(select * from e where not dup)')}),
        p as (select a.id as x, b.id as y from s a join s b on a.id < b.id and a.u <> 0 and b.u <> 0 and bit_count(xor(a.u, b.u)) <= 3)
        select doc_id, dup as is_exact_dup, (select count(*) from p where x = doc_id or y = doc_id) as n_near, (select min(x) from p where y = doc_id) as near_dup_of from e""",
    "content_filter": f"""with t as (select doc_id, coalesce(text, '') as text from documents),
        l as (select doc_id, text, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda s: {S.trimmed('s')}), lambda s: s <> '') as lines from t),
        n as (select *, list_sum(list_transform(lines, lambda s: {S.word_count('s')})) as n, list_sum(list_transform(regexp_extract_all(text, '\\[([^\\]]+)\\]\\([^\\)]+\\)', 1), lambda s: {S.word_count('s')})) as k from l),
        c as (select doc_id, text, len(lines) as m, len(list_distinct(lines)) as u, coalesce(n, 0) as n, coalesce(k, 0) as k, length({S.trimmed('text')}) < 80 as thin from n),
        f as (select *, k / greatest(n, 1) as dens, u / greatest(m, 1) < 0.35 and m > 10 as spam, ({' + '.join(f"cast(contains(lower(text), '{b}') as int)" for b in classify.BOILERPLATE_TERMS)}) >= 3 and length(text) < 500 as flooded from c),
        g as (select *, dens > 0.65 and not (n - k >= 350 and n / greatest(m, 1) >= 8) as nav from f)
        select doc_id, not (thin or nav or flooded or spam) as is_valid, case when thin then 0.0 else round(1 - dens, 6) end as main_text_ratio, case when thin then 0.0 else round(dens, 3) end as link_density, not thin and spam as is_spam, not thin and nav as is_navigation_only,
        case when thin then 'THIN_CONTENT_TOO_SHORT' when nav then 'NAVIGATION_DIRECTORY_PAGE' when flooded then 'BOILERPLATE_DOMINATED' when spam then 'REPETITIVE_SPAM_TEMPLATE' else '' end as rejection_reason from g""",
    "content_quality": f"""with t as (select doc_id, coalesce(text, '') as text, greatest(coalesce(n_chars, length(coalesce(text, ''))), 1) as raw from documents),
        c as (select *, {S.word_count('text')} as n, regexp_replace(text, '[\\s\\p{{Z}}\\x0B]+', '', 'g') = '' as empty, {S.any_of('lower(text)', classify.CHALLENGE_MARKERS)} as shell from t)
        select doc_id, case when empty or shell or (n < 30 and raw > 1500) then 'ESCALATE' when n < 10 then 'DISCARD' else 'ACCEPT' end as decision,
        case when empty then 0.0 when shell then 0.1 when n < 30 and raw > 1500 then 0.25 when n < 10 then 0.1 else round(least(1.0, 0.4 + 0.6 * least(1.0, n / 300.0::double)), 3) end as overall_score,
        case when empty then 0.0 when shell then 0.1 else round(least(1.0, length(text) / raw), 3) end as text_density, empty or shell as is_challenge_or_shell from c""",
    "paragraph_chunks": f"""select document_id, cast(row_number() over (partition by document_id, pos order by k) - 1 as int) as ordinal, s as text, {S.token_estimate('s')} as token_estimate from (
        select document_id, pos, unnest(range(len(l))) as k, {S.trimmed_ascii('unnest(l)')} as s from (select doc_id as document_id, row_number() over () as pos, string_split(text, chr(10) || chr(10)) as l from documents where text is not null)) where length(s) > 30""",
    "sparse_vectors": """with t as (select doc_id as id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_.-]+'), lambda t: length(t) > 1)) as w from documents where text is not null), c as (select id, w, count(*) as n from t group by id, w)
        select id, cast(('0x' || substr(md5(w), 1, 8))::bigint % 100000 as int) as bucket, max(round((1.0::double + (n - 1) * 0.2::double) * case when regexp_matches(w, '[-_.0-9]') then 1.5::double else 1.0 end, 3)) as value from c group by id, bucket""",
    "pseudo_vectors": f"""with t as (select doc_id as id, unnest({S.words('lower(text)')}) as w from documents), c as (select id, cast(('0x' || substr(md5(w), 1, 8))::bigint % 384 as int) as bucket, count(*) as n from t group by id, bucket)
        select id, bucket, round(n / sqrt(sum(n * n) over (partition by id)), 6) as value from c""",
    "cosine_topk": """with s as (select q.vec_id as query_id, v.vec_id, greatest(0, least(1, list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double)))) as s from embeddings q cross join embeddings v where q.vec_id % 50 = 0)
        select query_id, vec_id, round(s, 6) as similarity, r as rank from (select *, row_number() over (partition by query_id order by s desc, vec_id) as r from s) where r <= 10""",
    "kg_query": f"""with q as (select query_id, unnest(list_distinct(list_filter({S.tokens('query')}, lambda t: length(t) > 2))) as token from (values {', '.join(f"({i}, '{q}')" for i, q in enumerate(S.QUERIES))}) as v(query_id, query)),
        n as (select distinct 'doc:' || doc_id as node_id, unnest({S.tokens('case when t <> chr(32) then t end')}) as token from (select doc_id, case when {S.sanitised("string_split(text, chr(10))[1]")} <> '' then {S.sanitised("string_split(text, chr(10))[1]")} else 'Document ' || coalesce(url, '') end as t from documents where text is not null))
        select query_id, node_id, count(*) as matched from q join n using (token) group by query_id, node_id""",
}
