"""Queries over hits, candidates, claims and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import dedup, evidence, graphs, metrics, ranking, retrieval
from tessera.plans import sql as S
from tessera.session import materialise
from tessera.sources import table

HIT = ["id", "query_id", "chunk_id", "url", "title", "text", "source_type", "score", "authority_score", "goal_ids"]


def hits(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each hit id, with the retriever that found it as branch."""
    rows = table(spark, d, "retrieval_hits").select(*HIT, "retrieved_at", F.try_element_at("metadata", F.lit("retriever")).alias("retriever"))
    one = dedup.first_by(rows, ["id"], ["retrieved_at", "authority_score", "score"])
    return one.withColumn("branch", F.when(F.col("retriever").isin("sparse", "lexical", "bm25"), "sparse").otherwise("dense"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(hits(spark, d))


def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(hits(spark, d), {"dense": 0.6, "sparse": 0.4})


def _fused(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.fuse(hits(spark, d), {"dense": 0.6, "sparse": 0.4}).select("query_id", "id", "fusion_score")
    asked = table(spark, d, "search_queries").groupBy("query_id").agg(F.min("query").alias("query"))
    return fused.join(hits(spark, d).select("id", "url", "title", "text", "authority_score"), "id").join(asked, "query_id")


def rerank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rerank(_fused(spark, d)).select("query_id", "id", "rerank_score")


def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    return ranking.late_interaction(_fused(spark, d)).select("query_id", "id", "late_score")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rerank(_fused(spark, d)).withColumn("score", F.col("rerank_score"))
    placed = ranking.grouped_positions(rows, ["query_id"], [F.desc("rerank_score"), F.asc("id")], "place")
    return ranking.select_diverse(placed)


def filtered_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.filter_hits(hits(spark, d), {"source_type": "OFFICIAL_DOC", "goal_id": "g1", "unknown": "x"}).select("id", "query_id")


def payload_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval_hits").select("id", "source_type", "query_id", "chunk_id")
    return ranking.filter_payload(rows, {"source_type": "OFFICIAL_DOC", "query_id": None}).select("id", "chunk_id").distinct()


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.contradictions(evidence.claim_status(*_statements(spark, d)))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    seq = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("bigint")
    return hits(spark, d).select(
        seq.alias("seq"), "url", "title", F.substring("text", 1, 200).alias("snippet"), F.coalesce("retriever", F.lit("none")).alias("provider"), (F.pmod(seq, F.lit(7)) + 1).cast("int").alias("provider_rank"), "source_type",
        F.concat(F.lit("published "), (F.pmod(seq, F.lit(40)) + 1990).cast("string")).alias("published_at"), F.when(F.col("authority_score").between(0, 1), F.col("authority_score")).otherwise(0.5).alias("authority_prior"), "goal_ids", F.array("query_id").alias("query_variants"),
    )


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.merge_candidates(_candidates(spark, d))
    return rows.select("canonical", "domain", "title", F.length("snippet").alias("snippet_chars"), "provider_rank", "source_type", "authority_prior", F.array_join("providers", ",").alias("providers"), F.array_join("goal_ids", ",").alias("goal_ids"), F.size("query_variants").cast("bigint").alias("variants"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.merge_candidates(_candidates(spark, d)).withColumn("query", F.lit(S.QUERIES[0]))
    rows = ranking.lexical_score(rows)
    rows = retrieval.semantic_score(ranking.authority_prior(rows))
    return rows.withColumns(
        {
            "freshness": ranking.freshness(F.col("published_at"), F.lit("HIGH"), 2025),
            "cost": ranking.acquisition_cost(F.col("url"), F.col("domain")),
        }
    )


def pool_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank_pool(_scored(spark, d))
    return rows.select("canonical", "lexical", "authority", F.round("freshness", 6).alias("freshness"), "cost", "agreement", F.round("diversity", 6).alias("diversity"), "final_score", "rank")


def authority_join(spark: SparkSession, d: str) -> DataFrame:
    """Authority of pages' hosts by a dimension that hits the exact and the suffix branch."""
    dimension = spark.createDataFrame([("example", 0.60, 0), ("lab.example", 0.85, 1), ("open.bocor.example", 0.95, 2)], "domain string, authority double, place int")
    rows = table(spark, d, "captured_artifacts").select(U.authority(F.col("url")).alias("domain"), F.lit("WIKI").alias("source_type")).distinct()
    return ranking.authority_prior(rows, dimension=dimension)


def source_classes(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("id", ranking.source_class(F.col("url"), F.col("source_type"), F.col("title")).alias("source_class"))


def information_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).select("id", U.authority(F.col("url")).alias("domain"), F.when(F.col("authority_score").between(0, 1), F.col("authority_score")).otherwise(0.5).alias("authority_prior"), "goal_ids")
    goals = spark.createDataFrame([(f"g{i}", i / 8) for i in range(9)], "goal_id string, coverage double")
    covered = rows.where(F.col("authority_prior") > 0.95).select("domain")
    return ranking.information_gain(rows, goals, covered).select("id", "gain")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claims_from_passages(hits(spark, d).select("id", "chunk_id", "url", "text", "goal_ids", "authority_score", "source_type"))


def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("claim_id", "id", "ordinal", "statement", "goal_id", "domain", "relation")


def _statements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Claims are the sentences without figures; every passage that repeats one is evidence for it, its relation by a rule on its id."""
    rows = _claims(spark, d).withColumn("claim_id", F.substring(F.md5(F.regexp_replace("statement", "[0-9]+", "0")), 1, 12))
    n = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int")
    relation = F.when(F.pmod(n, F.lit(11)) == 0, "CONTRADICTS").when(F.pmod(n, F.lit(7)) == 0, "QUALIFIES").otherwise("SUPPORTS")
    return rows.select("claim_id", "goal_id", "statement"), rows.select("claim_id", F.concat_ws(":", "id", F.col("ordinal").cast("string")).alias("evidence_id"), relation.alias("relation"), "domain", "source_type")


def claim_status(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claim_status(*_statements(spark, d))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    goals = spark.createDataFrame([(f"g{i}", f"Answer primary research question: part {i}", 1.0 + i, ["OFFICIAL_DOC", "WIKI", f"T{i}"]) for i in range(9)], "goal_id string, question string, importance double, required_types array<string>")
    return evidence.goal_coverage(goals, *_statements(spark, d))


def goal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).withColumn("missing_types", F.array_join("missing_types", ","))


def research_progress(spark: SparkSession, d: str) -> DataFrame:
    return evidence.total_progress(_coverage(spark, d))


def research_gaps(spark: SparkSession, d: str) -> DataFrame:
    claims, items = _statements(spark, d)
    one = claims.groupBy("claim_id").agg(F.min(F.struct("goal_id", "statement")).alias("r")).select("claim_id", "r.*")
    return evidence.research_gaps(_coverage(spark, d), evidence.claim_status(claims, items), one)


def evidence_match(spark: SparkSession, d: str) -> DataFrame:
    """First sentence of each hit's title against its text."""
    return evidence.match_relation(hits(spark, d).select("id", F.col("title").alias("claim"), F.col("text").alias("evidence"))).select("id", "relation", "strength")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Without near-duplicate clusters, as its SQL has it; ``lineage_copies`` has them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("source_id"), U.authority(F.col("url")).alias("domain"), F.sha2("text", 256).alias("content_hash"), F.lit(0).alias("cluster"))
    return evidence.lineage(docs).select("source_id", "relation")


def independent_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("source_id"), U.authority(F.col("url")).alias("domain"), F.sha2("text", 256).alias("content_hash"), F.lit(0).alias("cluster"))
    return evidence.independent_sources(evidence.lineage(docs))


def _related_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their relation; clusters are numbered above 0, documents alone have none."""
    docs = table(spark, d, "documents")
    found = dedup.clusters(dedup.simhash(docs))
    several = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    numbered = several.crossJoin(F.broadcast(several.agg(F.min("cluster").alias("least"))))  # one row
    places = found.join(numbered, "cluster").select(F.col("id").alias("seq"), (F.col("cluster") - F.col("least") + 1).alias("cluster"))
    rows = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("source_id"), U.authority(F.col("url")).alias("domain"), F.sha2("text", 256).alias("content_hash"))
    return evidence.lineage(materialise(rows.join(places, "seq", "left")))  # read five times


def lineage_copies(spark: SparkSession, d: str) -> DataFrame:
    return _related_copies(spark, d).select("source_id", "relation")


def independent_sources_copies(spark: SparkSession, d: str) -> DataFrame:
    return evidence.independent_sources(_related_copies(spark, d))


def source_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).select(F.col("url").alias("source_id"), "url", "title", "source_type", F.col("score").alias("relevance_score"), "text")
    return evidence.source_quality(rows).withColumn("missing", F.array_join("missing", ","))


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors as retrieval, an equal label as relevance (grade 2 within the same hundred)."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    found = retrieval.nearest(vectors, asked.select(F.col("vec_id").alias("query_id"), "embedding")).select("query_id", F.col("vec_id").alias("id"), "rank")
    grade = F.when(F.floor(F.col("v.vec_id") / 100) == F.floor(F.col("q.vec_id") / 100), 2).otherwise(1)
    grades = asked.alias("q").join(vectors.alias("v"), F.col("q.label") == F.col("v.label")).select(F.col("q.vec_id").alias("query_id"), F.col("v.vec_id").alias("id"), grade.alias("grade"))
    return metrics.retrieval_metrics(found, grades)


def source_diversity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.diversity(hits(spark, d).withColumn("domain", U.authority(F.col("url"))), "query_id", "domain")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("domain"), kind.alias("provider"), (kind == "error").alias("error"), (kind != "error").alias("success"), ((kind == "error") & (F.col("event_id") % 2 == 0)).alias("blocked"),
        ((kind == "error") & (F.col("event_id") % 3 == 0)).alias("timeout"), F.round("value", 6).alias("latency"), F.round("value", 6).alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_id").alias("event_id"),
        F.pmod("event_id", F.lit(100)).alias("bytes"), F.pmod("event_id", F.lit(50)).alias("useful_bytes"), F.pmod("event_id", F.lit(3)).alias("retries"), F.element_at(F.array(F.lit("http"), F.lit("browser"), F.lit("api")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("strategy"),
    )


def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.domain_stats(_calls(spark, d))


def latency_ewma(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ewma(_calls(spark, d).select("domain", "provider", "value", "ts", "seq"), ["domain", "provider"])


def provider_health(spark: SparkSession, d: str) -> DataFrame:
    return metrics.provider_health(_calls(spark, d).withColumn("provider", F.concat_ws("-", "domain", "strategy")).withColumn("candidates", F.col("bytes")))


def telemetry_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.telemetry(_calls(spark, d))


def run_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_rates(_calls(spark, d).select(F.col("domain").alias("run"), F.col("error").alias("rejected"), F.col("blocked").alias("duplicate"), F.col("retries").alias("chunks")))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select(F.col("domain").alias("job"), "seq", "bytes", F.pmod("seq", F.lit(5)).alias("depth"))


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_totals(_requests(spark, d))


def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    return metrics.admit(_requests(spark, d), pages=40, bytes_=1500, depth=3)


def domain_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).select("seq", "domain", F.col("value").alias("priority"))
    return metrics.domain_turns(rows).select("seq", "domain", "turn")


def link_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Chunks reached over the neighbours of a document's first chunk."""
    chunks = table(spark, d, "structured_chunks").where("next_chunk_id is not null").select(F.col("chunk_id").alias("source"), F.col("next_chunk_id").alias("target")).distinct()
    starts = table(spark, d, "structured_chunks").where("ordinal = 0").select(F.col("chunk_id").alias("url"))
    return graphs.expand(chunks, starts, 3)


def r1_search_passages(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "rag_chunks").select(F.col("chunk_id").alias("id"), F.col("source_url").alias("url"), "title", "text", F.lit(0.5).alias("authority_score"))
    asked = spark.createDataFrame(list(enumerate(S.QUERIES)), "n int, query string").select(F.concat(F.lit("s"), "n").alias("query_id"), "query")
    return retrieval.search_passages(passages, asked)


QUERIES = {
    f.__name__: f
    for f in (
        rrf_fusion, weighted_rrf, rerank, late_interaction, mmr_select, filtered_hits, payload_hits, contradictions, candidate_merge, pool_rank, authority_join, source_classes, information_gain, claim_rows, claim_status, goal_coverage,
        research_progress, research_gaps, evidence_match, lineage, independent_sources, lineage_copies, independent_sources_copies, source_quality, ir_metrics, source_diversity, domain_stats, latency_ewma, provider_health, telemetry_summary, run_rates,
        running_totals, budget_admission, domain_turns, link_expansion, r1_search_passages,
    )
}

_HITS = """h as materialized (select *, case when metadata['retriever'] in ('sparse', 'lexical', 'bm25') then 'sparse' else 'dense' end as branch from (
  select *, row_number() over (partition by id order by retrieved_at nulls first, authority_score nulls first, score nulls first) as k from retrieval_hits) where k = 1)"""


def _fuse(dense: float, sparse: float) -> str:
    return f"""{_HITS}, r as (select *, row_number() over (partition by query_id, branch order by score desc nulls last, id) as r from h),
      e as (select query_id, id, round(sum(case branch when 'dense' then {dense}::double else {sparse}::double end / (60 + r)), 6) as fusion_score, min(case when branch = 'dense' then r end) as dense_rank, min(case when branch = 'sparse' then r end) as sparse_rank from r group by query_id, id),
      f as (select * from (select *, row_number() over (partition by query_id order by fusion_score desc, id) as place from e) where place <= 20)"""


_ASKED = _fuse(0.6, 0.4) + ", q as (select query_id, min(query) as query from search_queries group by query_id), j as (select f.query_id, f.id, fusion_score, title, text, url, authority_score, query from f join h using (id) join q on q.query_id = f.query_id)"
_SEQ = "('0x' || substr(md5(id), 1, 12))::bigint"
_PRIOR = "case when authority_score between 0 and 1 then authority_score else 0.5 end"
_CALLS = """c as (select user_id::varchar as domain, event_type as provider, event_type = 'error' as error, event_type = 'error' and event_id % 2 = 0 as blocked, event_type = 'error' and event_id % 3 = 0 as timeout, round(value, 6) as value, ts, event_id as seq,
  event_id % 100 as bytes, event_id % 50 as useful_bytes, event_id % 3 as retries, ['http', 'browser', 'api'][(event_id % 3 + 1)::int] as strategy from events)"""
_STATEMENTS = f"""{_HITS}, s as materialized (select id, chunk_id, url, goal_ids, source_type, unnest(range(len(l))) as k, {S.trimmed_ascii('unnest(l)')} as statement from (select *, string_split(regexp_replace(text, '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g'), chr(1)) as l from h where text is not null)),
  t as (select *, row_number() over (partition by id order by k) - 1 as ordinal from s where length(statement) > 30), u as materialized (select *, goal_ids[1] as goal_id, {S.authority('url')} as domain, substr(md5(regexp_replace(statement, '[0-9]+', '0', 'g')), 1, 12) as claim_id,
    case when ('0x' || substr(md5(id), 1, 4))::int % 11 = 0 then 'CONTRADICTS' when ('0x' || substr(md5(id), 1, 4))::int % 7 = 0 then 'QUALIFIES' else 'SUPPORTS' end as relation from t where ordinal < 3)"""
_STATUS = """a as (select claim_id, count(*) filter (relation = 'SUPPORTS') as s, count(*) filter (relation = 'CONTRADICTS') as c, count(*) filter (relation = 'QUALIFIES') as q, count(distinct case when relation = 'SUPPORTS' then domain end) as d from u group by claim_id),
  st as (select claim_id, s as supports, c as contradicts, q as qualifies, d as independent_sources, case when c > 0 and s > 0 then 'DISPUTED' when c > 0 then 'REFUTED' when s >= 2 and d >= 2 then 'VERIFIED' when s >= 1 then 'SUPPORTED' else 'UNVERIFIED' end as status,
    round(case when c > 0 and s > 0 then greatest(0.2, 0.5 + 0.1 * s - 0.3 * c) when c > 0 then 0.1 when s >= 2 and d >= 2 then least(1.0, 0.7 + 0.15 * s) when s >= 1 then 0.6 + 0.1 * s else 0.5 end, 6)::double as confidence from a)"""
_GOALS = """g as (select 'g' || i as goal_id, 'Answer primary research question: part ' || i as question, 1.0::double + i as importance, ['OFFICIAL_DOC', 'WIKI', 'T' || i] as need from range(9) r(i)),
  n1 as (select goal_id, count(distinct claim_id) as n from u group by goal_id), n2 as (select x.goal_id, count(distinct e.domain) as n, list(distinct e.source_type) as types from (select distinct goal_id, claim_id from u) x join u e on e.claim_id = x.claim_id and e.relation = 'SUPPORTS' group by x.goal_id),
  gc as (select g.*, coalesce(n1.n, 0) as claims_count, coalesce(n2.n, 0) as independent_sources, coalesce(n2.types, []) as types from g left join n1 on g.goal_id = n1.goal_id left join n2 on g.goal_id = n2.goal_id),
  cov as (select goal_id, question, importance, claims_count, independent_sources, list_sort(list_filter(need, lambda n: not list_contains(types, n))) as missing,
    round(0.5::double * least(1, claims_count / 3.0::double) + 0.3::double * least(1, independent_sources / 2.0::double) + 0.2::double * (1 - len(list_filter(need, lambda n: not list_contains(types, n))) / 3.0::double), 3) as coverage from gc)"""
_RELATED = f"""l as (select doc_id as seq, {S.authority('url')} as domain, case when text is not null then sha256(text) end as hash from documents),
  m as (select *, min(seq) over (partition by domain) as d, min(seq) over (partition by hash) as hh, min(seq) over () as f from l),
  o as (select seq as source_id, domain, case when domain is not null and d < seq then d end as d, case when hash is not null and hh < seq then hh end as hh, seq = f as top from m),
  related as (select source_id, domain, case when d = least(d, hh) then 'SAME_PUBLISHER' when hh = least(d, hh) then 'DERIVED_MIRROR' when top then 'PRIMARY_SOURCE' else 'INDEPENDENT_CORROBORATION' end as relation from o)"""
_MERGED = f"""{_HITS}, c as (select ('0x' || substr(md5(id), 1, 12))::bigint as seq, url, regexp_replace(coalesce(title, ''), '^ +| +$', '', 'g') as tt, regexp_replace(coalesce(substr(text, 1, 200), ''), '^ +| +$', '', 'g') as ss, coalesce(metadata['retriever'], 'none') as provider, source_type, case when authority_score between 0 and 1 then authority_score else 0.5::double end as prior, goal_ids, query_id from h where url is not null),
      u as ({S.canonical_rows("select * from c")}),
      p as (select canonical, string_agg(provider, ',' order by a) as providers, count(*) as np from (select canonical, provider, min(seq) as a from u group by all) group by canonical),
      g as (select canonical, string_agg(v, ',' order by a) as goal_ids from (select canonical, v, min(struct_pack(s := seq, i := i)) as a from (select canonical, seq, unnest(goal_ids) as v, unnest(range(len(goal_ids))) as i from u) where v is not null group by canonical, v) group by canonical),
      m as (select canonical, arg_max(tt, struct_pack(n := length(tt), s := -seq)) as title, arg_max(ss, struct_pack(n := length(ss), s := -seq)) as snippet, min(seq % 7 + 1) as provider_rank, arg_min_null(source_type, seq) as source_type, arg_min_null(url, seq) as url, max(prior) as authority_prior, count(distinct query_id) as variants, min(seq) as seq from u group by canonical),
      merged as (select m.*, {S.authority("m.canonical")} as domain, providers, np, coalesce(goal_ids, '') as goal_ids from m left join p using (canonical) left join g using (canonical))"""
_POOL_TOKENS = [t for t in S.QUERIES[0].lower().split() if len(t) > 2]
_MET = lambda c: f"len(list_filter([{S.quoted(_POOL_TOKENS)}], lambda t: contains(lower({c}), t))) / {len(_POOL_TOKENS)}::double"
_TYPES = "case " + " ".join(f"when source_type = '{k}' then {v}" for k, v in ranking.TYPE_AUTHORITY.items()) + " else 0.50 end::double"
_COUNTS = "select id, cast(('0x' || substr(md5(w), 1, 8))::bigint % 384 as int) as bucket, count(*)::double as n"
#: No address of the tables lies under a listed domain, so the authority is that of the type.
_POOL = f"""with {_MERGED},
      v as ({_COUNTS} from (select canonical as id, unnest({S.words("lower(title || '. ' || snippet)")}) as w from merged) group by all), vn as (select id, sqrt(sum(n * n)) as norm from v group by id),
      a as ({_COUNTS} from (select 0 as id, unnest({S.words(f"lower('{S.QUERIES[0]}')")}) as w) group by all), an as (select sqrt(sum(n * n)) as norm from a),
      near as (select v.id, {S.half_up("least(1.0::double, sum(v.n / vn.norm * (a.n / an.norm)))", 4)} as semantic from v join vn on v.id = vn.id join a using (bucket) cross join an group by v.id),
      s as (select merged.*, coalesce(semantic, 0) as semantic, {_TYPES} as authority, least(1.0::double, {S.half_up(f"{_MET('title')} * 0.35::double + {_MET('snippet')} * 0.20::double + {_MET('url')} * 0.15::double + greatest(0.0::double, (6 - least(provider_rank, 5)) * 0.02::double) + case when np > 1 then 0.10::double * (np - 1) else 0.0::double end", 4)}) as lexical,
        greatest(0.2::double, 1.0::double - 0.2::double * greatest(0, 2025 - (seq % 40 + 1990))) as freshness, case when lower(url) like '%.pdf' or contains(lower(url), '/pdf') then 1.2 else 1.0 end::double as cost,
        case when np > 1 then least(1.0::double, (np - 1) * 0.5::double) else 0.0::double end as agreement, greatest(0.0::double, 0.10::double - 0.03::double * (row_number() over (partition by domain order by seq) - 1)) as diversity from merged left join near on merged.canonical = near.id),
      f as (select *, greatest(0.0::double, least(1.0::double, {S.half_up(f"({S.half_up('0.35::double * lexical', 4)} + {S.half_up('0.25::double * semantic', 4)} + {S.half_up('0.25::double * authority', 4)} + {S.half_up('0.10::double * freshness', 4)} + {S.half_up('0.05::double * agreement', 4)} + {S.half_up('diversity', 4)}) / (0.8::double + 0.2::double * cost)", 4)})) as final_score from s)
      select canonical, lexical, authority, round(freshness, 6) as freshness, cost, agreement, round(diversity, 6) as diversity, final_score, row_number() over (order by final_score desc, canonical desc) as rank from f"""
_CLUSTERED = f"""s as materialized ({S.simhash("documents", "doc_id", S.tokens("text"))}), p as (select a.id as x, b.id as y from s a join s b on a.id <> b.id and a.u <> 0 and b.u <> 0 and bit_count(xor(a.u, b.u)) <= 3),
  g(id, seen) as (select id, id from s union select g.id, p.y from g join p on g.seen = p.x), w as (select id, min(seen) as cluster, count(*) as size from g group by id),
  l as (select doc_id as seq, {S.authority('url')} as domain, case when text is not null then sha256(text) end as hash, case when size > 1 then cluster end as c from documents left join w on doc_id = id),
  m as (select *, min(seq) over (partition by domain) as d, min(seq) over (partition by hash) as hh, min(seq) over (partition by c) as cc, min(seq) over () as f from l),
  o as (select seq as source_id, domain, case when domain is not null and d < seq then d end as d, case when hash is not null and hh < seq then hh end as hh, case when c is not null and cc < seq then cc end as cc, seq = f as top from m),
  related as (select source_id, domain, case when d = least(d, hh, cc) then 'SAME_PUBLISHER' when hh = least(d, hh, cc) then 'DERIVED_MIRROR' when cc = least(d, hh, cc) then 'SYNDICATED_COPY' when top then 'PRIMARY_SOURCE' else 'INDEPENDENT_CORROBORATION' end as relation from o)"""
_CLASS = f"""case when {S.any_of(f"lower({S.path('url')})", ranking.NAVIGATION_PATHS)} then 'navigation' when source_type in ({S.quoted(ranking.SECONDARY_TYPES)}) then 'secondary' when {S.authority('url')} in ({S.quoted(ranking.PREPRINT_HOSTS)}) then 'preprint'
  when source_type in ({S.quoted(ranking.OFFICIAL_TYPES)}) then 'official' when source_type = 'SOURCE_CODE' then 'dataset' when {S.any_of("lower(coalesce(title, ''))", ranking.SECONDARY_TITLES)} then 'secondary' else 'unknown' end"""
_DENSITY = "least(0.2::double, 0.05::double * (" + " + ".join(f"cast(regexp_matches(coalesce(text, ''), '{p}') as int)" for p in ranking.EMPIRICAL_PATTERNS) + "))"
_QT = f"list_filter({S.tokens('query')}, lambda t: length(t) > 2)"

ORACLE = {
    "rrf_fusion": f"with {_fuse(1, 1)} select * from f",
    "weighted_rrf": f"with {_fuse(0.6, 0.4)} select * from f",
    "rerank": f"""with {_ASKED} select query_id, id, least(1, greatest(0, round((0.55::double * len(list_filter({_QT}, lambda t: contains(lower(coalesce(text, '')), t) or contains(lower(coalesce(title, '')), t))) / greatest(len({_QT}), 1) + 0.35::double * fusion_score
      + case when contains(lower(coalesce(text, '')), lower(query)) then 0.2::double else 0 end + {_DENSITY}) * (0.8::double + 0.2::double * coalesce(authority_score, 0.5)), 4))) as rerank_score from j""",
    "late_interaction": f"""with {_ASKED}, w as (select query_id, id, fusion_score, {S.words("lower(query)")} as qw, list_slice({S.words("lower(coalesce(text, ''))")}, 1, 100) as dw from j)
      select query_id, id, round(cast(0.5::double * case when len(qw) > 0 and len(dw) > 0 then list_sum(list_transform(qw, lambda x: case when list_contains(dw, x) then 1.0::double when len(list_filter(dw, lambda y: contains(y, x) or contains(x, y))) > 0 then 0.5::double else 0 end)) / len(qw) else 0 end + 0.5::double * fusion_score as decimal(18, 10)), 4)::double as late_score from w""",
    "candidate_merge": f"with {_MERGED} select canonical, domain, title, length(snippet) as snippet_chars, provider_rank, source_type, authority_prior, providers, goal_ids, variants from merged",
    "pool_rank": _POOL,
    "contradictions": f"with {_STATEMENTS}, {_STATUS} select claim_id, status, contradicts from st where status = 'DISPUTED' or contradicts > 0",
    "payload_hits": "select distinct id, chunk_id from retrieval_hits where source_type = 'OFFICIAL_DOC'",
    "filtered_hits": f"with {_HITS} select id, query_id from h where source_type = 'OFFICIAL_DOC' and list_contains(goal_ids, 'g1')",
    "authority_join": f"""with p as (select distinct {S.authority('url')} as domain, 'WIKI' as source_type from captured_artifacts) select domain, source_type, case when domain is null then 0.75 when domain = 'open.bocor.example' then 0.95 when domain = 'lab.example' then 0.85 when domain = 'example' then 0.6
      when domain like '%.example' then 0.6 else 0.75 end::double as authority from p""",
    "source_classes": f"with {_HITS} select id, {_CLASS} as source_class from h",
    "information_gain": f"""with {_HITS}, c as (select id, {S.authority('url')} as domain, {_PRIOR} as p, goal_ids from h), v as (select distinct domain from c where p > 0.95),
      n as (select id, sum(1 - substr(g, 2)::int / 8.0::double) as deficit from (select id, unnest(goal_ids) as g from c) where regexp_matches(g, '^g[0-8]$') group by id)
      select c.id, greatest(0.05, least(1, round(0.5::double + 0.4::double * coalesce(deficit, 0) + case when v.domain is not null then -0.15::double else 0.2::double end + case when p >= 0.9 then 0.1::double else 0 end, 3))) as gain from c left join n on c.id = n.id left join v on c.domain = v.domain""",
    "claim_rows": f"with {_STATEMENTS} select substr(sha256(id || ':' || ordinal), 1, 12) as claim_id, id, ordinal::int as ordinal, statement, goal_id, domain, 'SUPPORTS' as relation from u",
    "claim_status": f"with {_STATEMENTS}, {_STATUS} select *, least(1, confidence) as clamped from st",
    "goal_coverage": f"with {_STATEMENTS}, {_GOALS} select goal_id, question, importance, claims_count, independent_sources, array_to_string(missing, ',') as missing_types, coverage, coverage >= 0.7 and independent_sources >= 1 as is_sufficient from cov",
    "research_progress": f"with {_STATEMENTS}, {_GOALS} select round(sum(coverage * importance) / sum(importance), 3) as overall_progress, count(*) filter (not (coverage >= 0.7 and independent_sources >= 1)) as insufficient from cov",
    "research_gaps": f"""with {_STATEMENTS}, {_STATUS}, {_GOALS}, o as (select claim_id, struct_pack(g := coalesce(goal_id, ''), s := statement) as r from (select *, row_number() over (partition by claim_id order by goal_id nulls first, statement) as n from u) where n = 1)
      select 'UNCOVERED_GOAL' as gap_type, goal_id, question as topic, round(1 - coverage, 6) as priority, replace(question, 'Answer primary research question: ', '') as followup from cov where coverage < 0.6
      union all select 'UNRESOLVED_CONTRADICTION', r.g, r.s, 0.95::double, r.s || ' meta-analysis systematic review clinical evidence' from st join o using (claim_id) where status = 'DISPUTED'""",
    "evidence_match": f"""with {_HITS}, m as (select id, lower(coalesce(text, '')) as low, list_distinct({S.tokens('title')}) as c, list_distinct({S.tokens('text')}) as e from h), n as (select *, len(list_intersect(c, e)) / greatest(len(c), 1) as o, {S.any_of('low', evidence.CONTRADICTION_MARKERS)} as a, {S.any_of('low', evidence.QUALIFICATION_MARKERS)} as p from m)
      select id, case when a then 'CONTRADICTS' when p then 'QUALIFIES' else 'SUPPORTS' end as relation, round(case when a then 0.85 when p then 0.75 when o >= 0.3 then least(1, 0.6::double + o * 0.4::double) else 0.5 end, 6) as strength from n""",
    "budget_admission": """with recursive r as (select user_id::varchar as job, event_id as seq, (event_id % 100)::bigint as bytes, event_id % 5 as depth, row_number() over (partition by user_id order by event_id) as k from events),
      f as (select job, seq, k, reason, case when reason is null then 1 else 0 end::bigint as n, case when reason is null then bytes else 0 end::bigint as used from (select *, case when depth > 3 then 'DEPTH' when bytes > 1500 then 'BYTES' end as reason from r where k = 1)
        union all select job, seq, k, reason, n + case when reason is null then 1 else 0 end, used + case when reason is null then bytes else 0 end
        from (select r.*, f.n, f.used, case when r.depth > 3 then 'DEPTH' when f.n + 1 > 40 then 'PAGES' when f.used + r.bytes > 1500 then 'BYTES' end as reason from f join r on r.job = f.job and r.k = f.k + 1))
      select job, seq, reason is null as admitted, reason from f""",
    "lineage_copies": f"with recursive {_CLUSTERED} select source_id, relation from related",
    "independent_sources_copies": f"with recursive {_CLUSTERED} select count(distinct case when relation in ('PRIMARY_SOURCE', 'INDEPENDENT_CORROBORATION') then domain end) as independent_sources from related",
    "lineage": f"with {_RELATED} select source_id, relation from related",
    "independent_sources": f"with {_RELATED} select count(distinct case when relation in ('PRIMARY_SOURCE', 'INDEPENDENT_CORROBORATION') then domain end) as independent_sources from related",
    "source_quality": f"""with {_HITS}, s as (select url, {S.authority('url')} as domain, {_CLASS} as cls, score, case when coalesce(text, '') = '' then 0 else greatest(1, cast(ceil({S.word_count('text')} / 250) as bigint)) end as n, {S.any_of("lower(coalesce(title, ''))", evidence.REVIEW_TITLES)} as rev from h),
      t as (select count(*) as accepted_count, count(distinct case when domain <> '' then domain end) as independent_domains, count(*) filter (cls in ('peer_reviewed', 'preprint', 'official') and coalesce(score, 0) >= 0.35) as direct_count, count(*) filter (rev) as review_count, cast(sum(n) as bigint) as total_chunks from s),
      x as (select t.*, direct_count / accepted_count as dr, (select max(k) from (select sum(n) as k from s group by url)) / total_chunks as mc from t),
      y as (select *, list_filter([case when independent_domains < 2 then 'MIN_INDEPENDENT_DOMAINS' end, case when direct_count < 3 then 'MIN_DIRECT_EVIDENCE' end, case when review_count < 1 and not (dr >= 0.85 and independent_domains >= 2 and accepted_count >= 3) then 'MIN_REVIEW_OR_BENCHMARK' end, case when mc > 0.5 then 'MAX_SOURCE_CHUNK_CONCENTRATION' end], lambda m: m is not null) as mis from x)
      select accepted_count, independent_domains, direct_count, review_count, total_chunks, round(dr, 3) as direct_rate, round(mc, 3) as max_concentration, array_to_string(mis, ',') as missing, len(mis) = 0 as passed from y""",
    "ir_metrics": """with s as (select q.vec_id as query_id, v.vec_id as id, q.label = v.label as rel, case when v.vec_id // 100 = q.vec_id // 100 then 2 else 1 end as g, row_number() over (partition by q.vec_id order by greatest(0, least(1, list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double)))) desc, v.vec_id) as r from embeddings q cross join embeddings v where q.vec_id % 50 = 0),
      i as (select *, row_number() over (partition by query_id, rel order by g desc, id) as p from s), a as (select query_id, count(*) filter (rel and r <= 10) as hits, min(case when rel and r <= 10 then r end) as f, sum(case when rel and r <= 10 then (pow(2, g) - 1) / log2(r + 1) else 0 end) as dcg, count(*) filter (rel) as n, sum(case when rel and p <= 10 then (pow(2, g) - 1) / log2(p + 1) else 0 end) as idcg from i group by query_id)
      select query_id, round(hits / n, 6) as recall, round(hits / 10, 6) as precision, round(coalesce(1 / f, 0), 6) as mrr, round(dcg / idcg, 6) as ndcg from a""",
    "source_diversity": f"""with {_HITS}, c as (select query_id, {S.authority('url')} as domain, count(*) as n from h where url is not null group by all), t as (select query_id, sum(n)::bigint as n, count(*) as kinds, sum(n * log2(n)) as l from c group by query_id)
      select query_id, n, kinds, round(case when kinds > 1 then (log2(n) - l / n) / log2(kinds) else 0 end, 6) as diversity from t""",
    "domain_stats": f"with {_CALLS} select domain, count(*) as attempts, count(*) filter (not error) as successes, count(*) filter (blocked) as blocks, count(*) filter (timeout) as timeouts, round(avg(value), 6) as avg_latency, round(count(*) filter (not error) / count(*), 2) as success_rate from c group by domain",
    "latency_ewma": f"""with {_CALLS}, b as (select *, row_number() over (partition by domain, provider order by ts desc, seq desc) - 1 as k, count(*) over (partition by domain, provider) as n from c where value is not null)
      select domain, provider, count(*) as attempts, round(sum(pow(0.8::double, k) * case when k = n - 1 then 1 else 0.2::double end * value), 6) as ewma from b group by domain, provider""",
    "provider_health": f"with {_CALLS}, p as (select domain || '-' || strategy as provider, count(*) as calls, count(*) filter (error) as errors, sum(bytes)::bigint as candidates from c group by all) select *, round(errors / calls, 6) as error_rate, case when errors / calls >= 0.8 and calls >= 3 then 0.2 when errors / calls >= 0.5 then 0.6 else 1.0 end::double as factor from p",
    "telemetry_summary": f"""with {_CALLS} select count(*) as total_requests, count(*) filter (strategy = 'http') as http_requests, count(*) filter (strategy = 'browser') as browser_requests, count(*) filter (strategy = 'api') as api_requests, sum(retries)::bigint as retries_total, sum(bytes)::bigint as total_bytes, sum(useful_bytes)::bigint as useful_bytes,
      round(count(*) filter (strategy = 'browser') / count(*) * 100, 2) as escalation_percent, round(sum(useful_bytes) / sum(bytes), 4) as useful_ratio, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) as per_second from c""",
    "run_rates": f"with {_CALLS}, r as (select domain as run, count(*) as documents, count(*) filter (error) as rejected, count(*) filter (blocked) as duplicates, sum(retries)::bigint as chunks from c group by domain) select *, round(100 * rejected / documents, 6) as rejected_percent, round(100 * duplicates / documents, 6) as duplicate_percent, round(chunks / documents, 6) as chunks_per_document from r",
    "running_totals": f"with {_CALLS} select domain as job, seq, count(*) over w as n, (sum(bytes) over w)::bigint as total, round(avg(bytes) over w, 6) as mean from c window w as (partition by domain order by seq rows unbounded preceding)",
    "domain_turns": f"with {_CALLS}, p as (select *, row_number() over (partition by domain order by value desc, seq) > 3 as spill from c) select seq, domain, row_number() over (order by spill, value desc, seq) - 1 as turn from p",
    "link_expansion": """with recursive e as (select distinct chunk_id as s, next_chunk_id as t from structured_chunks where next_chunk_id is not null), r as (select distinct chunk_id as url, 0 as depth from structured_chunks where ordinal = 0 union select e.t, r.depth + 1 from r join e on e.s = r.url where r.depth < 3)
      select url, min(depth)::int as depth from r group by url""",
}
