"""Claims, evidence, goals, lineage and source quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators.ranking import source_class

# --- fixed values ----------------------------------------------------------------------------

CONTRADICTION_MARKERS = ("not found", "failed to show", "no significant difference", "contradicts", "ineffective", "disputed", "no evidence", "refuted", "however, no", "adverse", "не обнаружено", "не подтвердилось", "опровергает", "противоречит", "неэффективно")
QUALIFICATION_MARKERS = ("only in cases of", "depends on", "limited to", "under specific conditions", "preliminary", "small sample", "только при условии", "зависит от", "ограничен")
REVIEW_TITLES = ("survey", "review", "benchmark", "evaluation", "ragas")
DIRECT_CLASSES = ("peer_reviewed", "preprint", "official")


def claims_from_passages(hits: DataFrame, most: int = 3, least_chars: int = 30) -> DataFrame:
    """The first sentences of more than ``least_chars`` characters of each passage (id, chunk_id, url, text,
    goal_ids, authority_score, source_type): claim_id, evidence columns, relation SUPPORTS, confidence .75."""
    first = F.slice(T.sentences(F.col("text"), least_chars), 1, most)
    rows = hits.where("text is not null").select("*", F.posexplode(first).alias("ordinal", "statement"))
    return rows.select(
        F.substring(F.sha2(F.concat_ws(":", "id", F.col("ordinal").cast("string")), 256), 1, 12).alias("claim_id"), "id", "ordinal", "statement", F.try_element_at("goal_ids", F.lit(1)).alias("goal_id"),
        "chunk_id", F.col("url").alias("source_url"), U.authority(F.col("url")).alias("domain"), F.lit("SUPPORTS").alias("relation"), F.lit(0.75).alias("confidence"), "authority_score", "source_type",
    )


def match_relation(df: DataFrame) -> DataFrame:
    """Adds relation and strength to rows with claim and evidence (null texts are empty)."""
    low = F.lower(F.coalesce("evidence", F.lit("")))
    c, e = F.array_distinct(T.tokens(F.col("claim"))), F.array_distinct(T.tokens(F.col("evidence")))
    shared = F.size(F.array_intersect(c, e)) / F.greatest(F.size(c), F.lit(1))
    against, partly = U.contains_any(low, CONTRADICTION_MARKERS), U.contains_any(low, QUALIFICATION_MARKERS)
    relation = F.when(against, "CONTRADICTS").when(partly, "QUALIFIES").otherwise("SUPPORTS")
    strength = F.when(against, 0.85).when(partly, 0.75).when(shared >= 0.3, F.least(F.lit(1.0), 0.6 + shared * 0.4)).otherwise(0.5)
    return df.withColumns({"relation": relation, "strength": F.round(strength, 6)})


def claim_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, supports, contradicts, qualifies, independent_sources, status, confidence.

    Evidence without a claim is left out; repeated evidence_ids count once; claims without evidence
    are UNVERIFIED. The confidence of SUPPORTED has no upper bound; ``clamped`` holds it to 1.
    """
    items = evidence.groupBy("claim_id", "evidence_id").agg(F.min("relation").alias("relation"), F.min("domain").alias("domain"))
    of = lambda r: F.count_if(F.col("relation") == r)
    sums = items.groupBy("claim_id").agg(of("SUPPORTS").alias("s"), of("CONTRADICTS").alias("c"), of("QUALIFIES").alias("q"), F.count_distinct(F.when(F.col("relation") == "SUPPORTS", F.col("domain"))).alias("d"))
    rows = claims.select("claim_id").distinct().join(sums, "claim_id", "left").na.fill(0, ["s", "c", "q", "d"])
    s, c, d = F.col("s"), F.col("c"), F.col("d")
    status = F.when((c > 0) & (s > 0), "DISPUTED").when(c > 0, "REFUTED").when((s >= 2) & (d >= 2), "VERIFIED").when(s >= 1, "SUPPORTED").otherwise("UNVERIFIED")
    sure = F.when((c > 0) & (s > 0), F.greatest(F.lit(0.2), 0.5 + 0.1 * s - 0.3 * c)).when(c > 0, 0.1).when((s >= 2) & (d >= 2), F.least(F.lit(1.0), 0.7 + 0.15 * s)).when(s >= 1, 0.6 + 0.1 * s).otherwise(0.5)
    out = rows.select("claim_id", s.alias("supports"), c.alias("contradicts"), F.col("q").alias("qualifies"), d.alias("independent_sources"), status.alias("status"), F.round(sure, 6).alias("confidence"))
    return out.withColumn("clamped", F.least(F.lit(1.0), "confidence"))


def contradictions(status: DataFrame) -> DataFrame:
    """claim_id, status, contradicts of the claims that are disputed or have evidence against them."""
    return status.where("status = 'DISPUTED' or contradicts > 0").select("claim_id", "status", "contradicts")


def goal_coverage(goals: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """goal_id, claims_count, independent_sources, missing_types, coverage, is_sufficient.

    ``goals`` has goal_id and required_types; half of the score is for three claims, .3 for two
    independent sources, .2 for the required types that were found.
    """
    counts = claims.groupBy("goal_id").agg(F.count_distinct("claim_id").alias("claims_count"))
    support = claims.select("goal_id", "claim_id").distinct().join(evidence.where("relation = 'SUPPORTS'"), "claim_id")
    sources = support.groupBy("goal_id").agg(F.count_distinct("domain").alias("independent_sources"), F.collect_set("source_type").alias("types"))
    rows = goals.join(counts, "goal_id", "left").join(sources, "goal_id", "left").na.fill(0, ["claims_count", "independent_sources"])
    need = F.coalesce(F.array_distinct("required_types"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(need, F.coalesce("types", F.array().cast("array<string>"))))
    kinds = F.when(F.size(need) > 0, 1.0 - F.size(missing) / F.size(need)).otherwise(1.0)
    score = F.round(0.50 * F.least(F.lit(1.0), F.col("claims_count") / 3.0) + 0.30 * F.least(F.lit(1.0), F.col("independent_sources") / 2.0) + 0.20 * kinds, 3)
    out = rows.select(*[c for c in goals.columns if c != "required_types"], "claims_count", "independent_sources", missing.alias("missing_types"), score.alias("coverage"))
    return out.withColumn("is_sufficient", (F.col("coverage") >= 0.70) & (F.col("independent_sources") >= 1))


def total_progress(covered: DataFrame) -> DataFrame:
    """One row: importance-weighted mean of coverage (0 without weight), rounded to three places."""
    weight = F.sum("importance")
    return covered.agg(F.round(F.coalesce(F.when(weight > 0, F.sum(F.col("coverage") * F.col("importance")) / weight), F.lit(0.0)), 3).alias("overall_progress"), F.count_if(~F.col("is_sufficient")).alias("insufficient"))


def research_gaps(covered: DataFrame, status: DataFrame, claims: DataFrame, root: str = "") -> DataFrame:
    """gap_type, goal_id, topic, priority, followup: goals covered below .6, and disputed claims."""
    open_ = covered.where("coverage < 0.6").select(F.lit("UNCOVERED_GOAL").alias("gap_type"), "goal_id", F.col("question").alias("topic"), F.round(1.0 - F.col("coverage"), 6).alias("priority"))
    disputed = status.where("status = 'DISPUTED'").join(claims.select("claim_id", "goal_id", "statement").distinct(), "claim_id")
    fought = disputed.select(F.lit("UNRESOLVED_CONTRADICTION").alias("gap_type"), F.coalesce("goal_id", F.lit(root)).alias("goal_id"), F.col("statement").alias("topic"), F.lit(0.95).alias("priority"))
    plain = F.replace(F.replace(F.col("topic"), F.lit("Answer primary research question: "), F.lit("")), F.lit("Investigate characteristics and properties of "), F.lit(""))
    asked = F.when(F.col("gap_type") == "UNCOVERED_GOAL", plain).otherwise(F.concat("topic", F.lit(" meta-analysis systematic review clinical evidence")))
    return open_.unionByName(fought).withColumn("followup", asked)


def lineage(sources: DataFrame) -> DataFrame:
    """Adds relation to sources (seq, source_id, domain, content_hash, cluster).

    The earliest earlier source that shares the domain, the content or the near-duplicate cluster
    decides, in this order for one source: SAME_PUBLISHER, DERIVED_MIRROR, SYNDICATED_COPY. The very
    first is PRIMARY_SOURCE, others INDEPENDENT_CORROBORATION. The first row of each key suffices,
    so no pairs are built.
    """

    rows = sources
    for column, name, good in (("domain", "_d", F.col("domain").isNotNull()), ("content_hash", "_h", F.coalesce("content_hash", F.lit("")) != ""), ("cluster", "_c", F.coalesce("cluster", F.lit(0)) > 0)):
        first = sources.where(good).groupBy(F.col(column).alias("_key")).agg(F.min("seq").alias("_seq"))
        rows = rows.join(first, F.col(column) == F.col("_key"), "left").withColumn(name, F.when(F.col("_seq") < F.col("seq"), F.col("_seq"))).drop("_key", "_seq")
    least = F.least("_d", "_h", "_c")
    start = sources.agg(F.min("seq").alias("_first"))
    rows = rows.join(F.broadcast(start))  # one row
    relation = F.when(F.col("_d") == least, "SAME_PUBLISHER").when(F.col("_h") == least, "DERIVED_MIRROR").when(F.col("_c") == least, "SYNDICATED_COPY").when(F.col("seq") == F.col("_first"), "PRIMARY_SOURCE").otherwise("INDEPENDENT_CORROBORATION")
    return rows.withColumn("relation", relation).drop("_d", "_h", "_c", "_first")


def independent_sources(related: DataFrame) -> DataFrame:
    return related.agg(F.count_distinct(F.when(F.col("relation").isin("PRIMARY_SOURCE", "INDEPENDENT_CORROBORATION"), F.col("domain"))).alias("independent_sources"))


def source_rows(df: DataFrame) -> DataFrame:
    """Adds source_class, chunk_count, direct_evidence, is_review to rows with url, title, source_type, relevance_score, text."""
    n = T.word_count(F.col("text"))
    rows = df.withColumn("source_class", source_class(F.col("url"), F.col("source_type"), F.col("title"))).withColumn("domain", U.authority(F.col("url")))
    return rows.withColumns(
        {
            "chunk_count": F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / 250))).cast("bigint"),
            "direct_evidence": F.col("source_class").isin(*DIRECT_CLASSES) & (F.coalesce("relevance_score", F.lit(0.0)) >= 0.35),
            "is_review": U.contains_any(F.lower(F.coalesce("title", F.lit(""))), REVIEW_TITLES),
        }
    )


def source_quality(df: DataFrame, domains: int = 2, direct: int = 3, reviews: int = 1, concentration: float = 0.50) -> DataFrame:
    """One row: counts, rates, missing requirements, passed. ``df`` as for source_rows, with source_id."""
    rows = source_rows(df)
    per = rows.groupBy("source_id").agg(F.sum("chunk_count").alias("chunks"))
    most = per.agg(F.coalesce(F.max("chunks"), F.lit(0)).alias("most"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))
    flat = rows.agg(
        F.count("*").alias("accepted_count"), F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("independent_domains"), F.count_if("direct_evidence").alias("direct_count"), F.count_if("is_review").alias("review_count"),
    )
    one = flat.join(F.broadcast(most))  # one row each
    one = one.withColumn("direct_rate", F.col("direct_count") / F.greatest("accepted_count", F.lit(1))).withColumn("max_concentration", F.col("most") / F.greatest("total_chunks", F.lit(1)))
    excused = (F.col("direct_rate") >= 0.85) & (F.col("independent_domains") >= 2) & (F.col("accepted_count") >= 3)
    missing = F.filter(
        F.array(
            F.when(F.col("independent_domains") < domains, "MIN_INDEPENDENT_DOMAINS"), F.when(F.col("direct_count") < direct, "MIN_DIRECT_EVIDENCE"),
            F.when((F.col("review_count") < reviews) & ~excused, "MIN_REVIEW_OR_BENCHMARK"), F.when(F.col("max_concentration") > concentration, "MAX_SOURCE_CHUNK_CONCENTRATION"),
        ),
        lambda m: m.isNotNull(),
    )
    one = one.withColumn("missing", missing)
    return one.select("accepted_count", "independent_domains", "direct_count", "review_count", "total_chunks", F.round("direct_rate", 3).alias("direct_rate"), F.round("max_concentration", 3).alias("max_concentration"), "missing", ((F.col("accepted_count") > 0) & (F.size("missing") == 0)).alias("passed"))
