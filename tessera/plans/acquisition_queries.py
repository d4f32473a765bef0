"""Queries over captures, saved service answers and exports."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import acquisition, classify, metrics, ranking
from tessera.plans import research
from tessera.plans import sql as S
from tessera.plans.ranking_queries import _HITS, hits
from tessera.session import remove, shared_dir
from tessera.sources import providers, sinks, table


def best_capture(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.best_capture(table(spark, d, "captured_artifacts"))


def escalation(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_intelligence")
    rows = table(spark, d, "captured_artifacts")
    return rows.select(
        "artifact_id", acquisition.next_strategy(F.col("strategy_used"), F.coalesce(p["content_quality"], F.lit(0.0)), F.coalesce(p["api_score"] > 0, F.lit(False)), F.coalesce(p["visual_score"], F.lit(0.0))).alias("next"),
        acquisition.needs_browser(F.lit("adaptive"), p["js_dependency_score"], p["block_score"], F.lit(False), F.coalesce(F.col("status_code") >= 400, F.lit(False))).alias("browser"),
    )


def page_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rag_chunks").select("chunk_id", "source_url", "ordinal").distinct()
    return acquisition.capped(rows, "source_url", [F.col("source_url"), F.col("ordinal"), F.col("chunk_id")], 3, 200).select("chunk_id", "place")


def strategy_states(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.state_counts(table(spark, d, "captured_artifacts").select(F.col("strategy_used").alias("state")))


def cheapest_backend(spark: SparkSession, d: str) -> DataFrame:
    """Backends with success rates learnt from the events of a user; each user asks once."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("request_id")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    options = F.array(*[F.struct(F.lit(n).alias("backend"), F.lit(b).alias("base_cost"), F.lit(s).alias("startup_cost"), F.lit(f).alias("f")) for n, b, s, f in (("http", 1.0, 0.0, 0.5), ("browser", 2.0, 5.0, 1.0), ("api", 1.5, 1.0, 0.8))])
    rows = rows.select("request_id", "n", "ok", F.explode(options).alias("o")).select("request_id", "o.*", metrics.success_probability(F.col("n"), F.col("ok") * F.col("o.f")).alias("p_success"))
    return ranking.cheapest_backend(rows)


def general_results(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as a service's JSON answers and read again as candidates."""
    body = F.to_json(F.struct(F.array(F.struct("url", "title", F.col("text").alias("snippet"))).alias("results")))
    answers = hits(spark, d).select(F.col("id").alias("query_id"), "query_id", body.alias("body")).toDF("query_id", "goal_id", "body")
    return providers.general(answers).select("query_id", "goal_id", "url", "title", F.md5("snippet").alias("snippet"), "source_type", "provider_rank")


def inverted_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Titles turned into inverted indexes and read back through a service's reader."""
    words = F.split("title", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda v, i: F.when(v == w, i)), lambda i: i.isNotNull()))))
    body = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("id"), F.col("title"), index.alias("abstract_inverted_index"), F.lit(2020).alias("publication_year"), F.pmod(F.length("text"), F.lit(200)).alias("cited_by_count"), F.lit("article").alias("type"))).alias("results")))
    answers = hits(spark, d).where("title is not null and url is not null").select(F.col("id").alias("query_id"), F.lit("g").alias("goal_id"), body.alias("body"))
    return providers.openalex(answers).select("query_id", "url", "snippet", "source_type", "authority_prior")


def query_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(research.entity_column(F.col("text"))).alias("e"))
    return rows.groupBy("e.kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def dataset_export(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.dataset_rows(table(spark, d, "rag_chunks"), "q")
    return rows.select("id", F.md5("text").alias("text"), F.col("metadata.source_url").alias("source_url"), F.col("metadata.domain").alias("domain"))


def citation_export(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("n"), "url", F.split("text", "\n")[0].alias("title"), F.col("text").alias("markdown"))
    csl = lambda name: F.get_json_object("csl", f"$.{name}")
    return sinks.citations(docs, "q", "2025-01-02").select("n", F.md5("ris").alias("ris"), csl("id").alias("id"), F.md5(csl("title")).alias("title"), csl("container-title").alias("host"), csl("accessed.date-parts").alias("accessed"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """What a content store holds after captures were written to it: each content once, by its hash and shard."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    sinks.store_contents(table(spark, d, "captured_artifacts").select(F.col("raw_content").alias("content")), path)
    return spark.read.parquet(path).groupBy(F.substring("prefix", 1, 1).alias("shard")).agg(F.count("*").alias("contents"), F.sum(F.length("content")).alias("bytes"))


def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    required = F.array(F.lit("title"), F.lit("table"))
    rows = table(spark, d, "extracted_content").select("content_id", F.coalesce("clean_markdown", F.lit("")).alias("m"), F.size("tables").alias("tables")).distinct()
    fields = F.filter(F.array(F.when(F.col("m").startswith("# "), "title"), F.when(F.col("tables") > 0, "table")), lambda x: x.isNotNull())
    return rows.select("content_id", F.round(classify.extraction_score(fields, required, F.col("tables"), F.length("m"), F.col("m")), 6).alias("score"))


QUERIES = {f.__name__: f for f in (best_capture, escalation, page_caps, strategy_states, cheapest_backend, general_results, inverted_abstracts, query_entities, dataset_export, citation_export, content_hashes, extraction_quality)}

_TITLES = "h.title is not null and h.url is not null"
#: Word boundaries know all letters in the engine and ASCII ones in the SQL, so other letters become one.
_LETTERED = "regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', 'q', 'g')"
_KINDS = " union all ".join(f"select doc_id, '{kind}' as kind, unnest(list_distinct(regexp_extract_all({_LETTERED if kind != 'STANDARD' else 'text'}, '{pattern}'))) as name from documents" for kind, pattern in research.PATTERNS.items())
_TERMS = " union all ".join(f"select doc_id, '{kind}', '{name}' from documents where contains(lower(text), '{name}')" for kind, names in research.TERMS.items() for name in names)

ORACLE = {
    "query_entities": f"select kind, count(*) as n, count(distinct doc_id) as documents from ({_KINDS} union all {_TERMS}) group by kind",
    "best_capture": f"""select canonical_url, artifact_id, strategy_used from (select *, row_number() over (partition by canonical_url order by coalesce(regexp_replace(text_content, '^ +| +$', '', 'g') = '', true), coalesce(list_position([{S.quoted(acquisition.TIERS)}], strategy_used), {len(acquisition.TIERS) + 1}), coalesce(epoch_us(captured_at), 0) desc, artifact_id) as k
      from captured_artifacts where canonical_url is not null) where k = 1""",
    "escalation": """with c as (select *, page_intelligence as p from captured_artifacts) select artifact_id, case when coalesce(p.content_quality, 0) >= 0.85 then strategy_used when strategy_used = 'cache' then 'http' when strategy_used = 'http' then case when coalesce(p.api_score > 0, false) then 'api' else 'browser' end
      when strategy_used in ('api', 'browser') then case when coalesce(p.visual_score, 0) >= 0.6 then 'visual' else 'semantic' end when strategy_used = 'semantic' then 'visual' else strategy_used end as next,
      coalesce(status_code >= 400, false) or coalesce(p.js_dependency_score, 0) >= 0.7 or coalesce(p.block_score, 0) >= 0.5 as browser from c""",
    "page_caps": "with r as (select distinct chunk_id, source_url, ordinal from rag_chunks), a as (select *, row_number() over (partition by source_url order by ordinal, chunk_id) as k from r) select chunk_id, place from (select chunk_id, row_number() over (order by source_url, ordinal, chunk_id) - 1 as place from a where k <= 3) where place < 200",
    "strategy_states": "select strategy_used as state, count(*) as n from captured_artifacts group by 1",
    "cheapest_backend": """with e as (select user_id as request_id, count(*) as n, count(*) filter (event_type <> 'error') as ok from events group by 1), o as (select * from (values ('http', 1.0::double, 0.0::double, 0.5::double), ('browser', 2.0, 5.0, 1.0), ('api', 1.5, 1.0, 0.8)) v(backend, b, s, f)),
      c as (select request_id, backend, (b + 0.1::double * s) / case when n < 3 then 0.95::double else greatest(0.05, least(0.99, ok * f / n)) end as cost from e cross join o)
      select request_id, backend, round(cost, 6) as expected_cost from (select *, row_number() over (partition by request_id order by cost, backend) as k from c) where k = 1""",
    "general_results": f"""with {_HITS} select id as query_id, query_id as goal_id, url, coalesce(title, '') as title, md5(substr(coalesce(text, ''), 1, 400)) as snippet, case when regexp_matches(url, '{"|".join(p.replace(".", "[.]") for p in providers.RESEARCH_PARTS)}') then 'PRIMARY_RESEARCH' else 'OFFICIAL_DOC' end as source_type, 1 as provider_rank from h where starts_with(url, 'http')""",
    "inverted_abstracts": f"""with {_HITS} select id as query_id, url, case when title <> '' then substr(title, 1, 350) else 'Published in 2020, Cited by ' || (length(text) % 200) || ' researchers.' end as snippet, case when contains(lower(title), 'review') then 'SYSTEMATIC_REVIEW' else 'PRIMARY_RESEARCH' end as source_type,
      case when length(text) % 200 > 150 then 0.99 when length(text) % 200 > 30 then 0.95 else 0.93 end::double as authority_prior from h where {_TITLES} and url <> ''""",
    "citation_export": f"""with t as (select doc_id::int as n, url, {S.authority("coalesce(url, '')")} as net, case when string_split(text, chr(10))[1] <> '' then string_split(text, chr(10))[1] else 'Document ' || doc_id end as title, coalesce(text, '') as text, 'ref_' || case when length(doc_id::varchar) < 3 then lpad(doc_id::varchar, 3, '0') else substr(doc_id::varchar, 1, 3) end as id from documents)
      select n, id, md5(title) as title, net as host, '[[2025,1,2]]' as accessed, md5('TY  - ELEC' || chr(10) || 'ID  - ' || id || chr(10) || 'TI  - ' || title || chr(10) || 'UR  - ' || coalesce(url, '') || chr(10) || 'PB  - ' || net || chr(10) || 'AB  - ' || replace(substr(text, 1, 600), chr(10), ' ') || chr(10) || 'Y2  - 2025/01/02' || chr(10) || 'KW  - q' || chr(10) || 'ER  - ') as ris from t""",
    "dataset_export": f"select chunk_id as id, md5({S.sanitised('text')}) as text, source_url, 'Global' as domain from rag_chunks",
    "content_hashes": "select substr(h, 1, 1) as shard, count(*) as contents, sum(n)::bigint as bytes from (select distinct sha256(raw_content) as h, octet_length(raw_content) as n from captured_artifacts where raw_content is not null) group by 1",
    "extraction_quality": """select content_id, round(0.3::double * (cast(starts_with(m, '# ') as int) + cast(t > 0 as int)) / 2 + 0.2::double * cast(t > 0 as int) + 0.2::double * greatest(0.1, least(1, length(m) / 50000.0::double)) + 0.15::double * cast(m <> '' as int) + 0.15::double * cast(starts_with(m, '# ') or t > 0 as int), 6) as score
      from (select distinct content_id, coalesce(clean_markdown, '') as m, coalesce(len(tables), -1) as t from extracted_content)""",
}
