"""Scores, fusion, reranking, candidate merging and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.operators.positions import grouped_positions

# --- fixed values ----------------------------------------------------------------------------

AUTHORITY = {
    "europepmc.org": 0.95, "ncbi.nlm.nih.gov": 0.95, "pubmed.ncbi.nlm.nih.gov": 0.96, "semanticscholar.org": 0.96, "api.semanticscholar.org": 0.96,
    "openalex.org": 0.95, "crossref.org": 0.96, "api.crossref.org": 0.96, "arxiv.org": 0.90, "export.arxiv.org": 0.90, "biorxiv.org": 0.90,
    "medrxiv.org": 0.90, "chemrxiv.org": 0.90, "nature.com": 0.98, "science.org": 0.98, "cell.com": 0.98, "thelancet.com": 0.98, "nejm.org": 0.98,
    "bmj.com": 0.97, "jamanetwork.com": 0.97, "pnas.org": 0.96, "ieeexplore.ieee.org": 0.96, "ieee.org": 0.95, "dl.acm.org": 0.96, "acm.org": 0.95,
    "springer.com": 0.96, "link.springer.com": 0.96, "sciencedirect.com": 0.96, "wiley.com": 0.95, "onlinelibrary.wiley.com": 0.95,
    "tandfonline.com": 0.94, "mdpi.com": 0.90, "frontiersin.org": 0.90, "plos.org": 0.92, "hal.science": 0.93, "cyberleninka.ru": 0.92,
    "elibrary.ru": 0.90, "scielo.org": 0.92, "jstage.jst.go.jp": 0.92, "doi.org": 0.92, "github.com": 0.90, "huggingface.co": 0.93,
    "kaggle.com": 0.90, "qdrant.tech": 0.92, "servo.org": 0.92, "mozilla.org": 0.92, "developer.mozilla.org": 0.95, "docs.python.org": 0.95,
    "rust-lang.org": 0.95, "ietf.org": 0.96, "w3.org": 0.96, "iso.org": 0.96, "fda.gov": 0.95, "nih.gov": 0.95, "who.int": 0.95,
    "cdc.gov": 0.92, "gost.ru": 0.95, "docs.cntd.ru": 0.90,
}
TYPE_AUTHORITY = {
    "GUIDELINE": 0.94, "REGULATOR": 0.94, "STANDARD": 0.94, "META_ANALYSIS": 0.96, "SYSTEMATIC_REVIEW": 0.96, "PRIMARY_RESEARCH": 0.92,
    "OFFICIAL_DOC": 0.90, "GOVERNMENT": 0.92, "SOURCE_CODE": 0.85, "WIKI": 0.75, "NEWS_MEDIA": 0.70, "MARKETING": 0.40,
}
FORUM_TYPES, FORUM_TASKS = ("FORUM", "ISSUE_TRACKER"), ("technical", "bug", "user_experience")
PEER_REVIEWED = (
    "nature.com", "science.org", "cell.com", "thelancet.com", "nejm.org", "bmj.com", "springer.com", "sciencedirect.com", "mdpi.com",
    "frontiersin.org", "plos.org", "acm.org", "ieeexplore.ieee.org", "wiley.com", "tandfonline.com", "pubmed.ncbi.nlm.nih.gov",
    "semanticscholar.org", "openalex.org", "hal.science", "cyberleninka.ru", "scielo.org", "jstage.jst.go.jp",
)
PREPRINT_HOSTS = ("arxiv.org", "export.arxiv.org", "biorxiv.org", "medrxiv.org")
NAVIGATION_PATHS = ("/search", "/results", "/browse", "/login", "/accounts/login")
SECONDARY_TYPES, SECONDARY_TITLES = ("WIKI", "AGGREGATOR", "BLOG", "NEWS_MEDIA", "NEWS_WIRE"), ("survey", "systematic review", "meta-analysis", "benchmark")
OFFICIAL_TYPES = ("REGULATOR", "GUIDELINE", "STANDARD", "GOVERNMENT", "OFFICIAL_DOC")
CHEAP_HOSTS, COSTLY_HOSTS = ("arxiv.org", "europepmc.org", "wikipedia.org", "github.com"), ("twitter.com", "x.com", "linkedin.com", "medium.com")
EMPIRICAL_PATTERNS = (
    r"(?i)\bp\s*[<=]\s*0\.\d+",
    r"(?i)95%\s*(ci|confidence interval)",
    r"(?i)\b(n|sample size)\s*=\s*\d+",
    r"(?i)\b\d+(\.\d+)?\s*(%|mg/kg|μm|um|nm|w|kw|j/cm2|bar|mpa|ghz|m/min|rpm|kb|mb)\b",
    r"(?i)\b(auroc|f1-score|sensitivity|specificity|accuracy|hazard ratio|odds ratio|relative risk)\b",
    r"\d+(\.\d+)?\s*±\s*\d+(\.\d+)?",
)
RRF_K = 60


def authority_prior(df: DataFrame, task: str = "general_research", dimension: DataFrame | None = None) -> DataFrame:
    """Adds authority to rows with domain and source_type.

    The domain itself, else the first domain of the list that it lies under, else the type, else .5.
    ``dimension`` (domain, authority, place) replaces the list; each suffix of a domain is looked up,
    so the join is on equality and its size that of the domains.
    """
    spark = df.sparkSession
    if dimension is None:
        dimension = spark.createDataFrame([(d, a, i) for i, (d, a) in enumerate(AUTHORITY.items())], "domain string, authority double, place int")
    names = df.select(F.lower("domain").alias("d")).distinct().where("d is not null")
    parts = names.withColumn("p", F.split("d", r"\."))
    suffixes = parts.select("d", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("s"))
    hit = suffixes.join(dimension.select(F.lower("domain").alias("s"), F.col("authority").alias("a"), "place"), "s")
    best = hit.groupBy("d").agg(F.min_by("a", F.struct(F.col("s") != F.col("d"), "place")).alias("listed"))
    types = F.create_map(*[F.lit(x) for p in TYPE_AUTHORITY.items() for x in p])
    kind = F.coalesce("source_type", F.lit("UNKNOWN"))
    by_type = F.when(kind.isin(*FORUM_TYPES), 0.70 if task in FORUM_TASKS else 0.50).otherwise(F.coalesce(F.try_element_at(types, kind), F.lit(0.50)))
    return df.join(best.withColumnRenamed("d", "_d"), F.lower("domain") == F.col("_d"), "left").withColumn("authority", F.coalesce("listed", by_type)).drop("_d", "listed")


def authority_score(prior: Column, cited: Column, reviewed: Column, official: Column) -> Column:
    """The prior, at least .92 for reviewed or official sources, .05 more with citations, at most 1."""
    base = F.when(reviewed | official, F.greatest(prior, F.lit(0.92))).otherwise(prior)
    return F.round(F.when(cited, F.least(F.lit(1.0), base + 0.05)).otherwise(base), 3)


def source_class(url: Column, source_type: Column, title: Column) -> Column:
    """Role of a source by its address, type and title."""
    net, way, kind, name = U.authority(F.coalesce(url, F.lit(""))), F.lower(U.path(F.coalesce(url, F.lit("")))), F.coalesce(source_type, F.lit("UNKNOWN")), F.lower(F.coalesce(title, F.lit("")))
    reviewed = net.rlike("^(.*\\.)?(" + "|".join(d.replace(".", "\\.") for d in PEER_REVIEWED) + ")$")
    return (
        F.when(U.contains_any(way, NAVIGATION_PATHS), "navigation")
        .when(kind.isin(*SECONDARY_TYPES), "secondary")
        .when(net.isin(*PREPRINT_HOSTS), "preprint")
        .when((net == "europepmc.org") & F.contains(way, F.lit("/article/")), "peer_reviewed")
        .when(reviewed, "peer_reviewed")
        .when(kind.isin(*OFFICIAL_TYPES), "official")
        .when(kind == "SOURCE_CODE", "dataset")
        .when(U.contains_any(name, SECONDARY_TITLES), "secondary")
        .otherwise("unknown")
    )


def freshness(published: Column, requirement: Column, as_of_year: int) -> Column:
    """Freshness by the first year 19xx or 20xx in ``published`` and what is asked for."""
    year = F.regexp_extract(F.coalesce(published, F.lit("")), r"\b(19\d{2}|20\d{2})\b", 1)
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year.try_cast("int"))
    dated = F.when(requirement == "REALTIME", F.when(age == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - 0.4 * age)))
    dated = dated.when(requirement == "HIGH", F.greatest(F.lit(0.2), 1.0 - 0.2 * age)).when(requirement == "MEDIUM", F.greatest(F.lit(0.3), 1.0 - 0.1 * age)).otherwise(0.6)
    undated = F.when(requirement.isin("HIGH", "REALTIME"), 0.4).otherwise(0.5)
    return F.when(F.coalesce(requirement, F.lit("NONE")) == "NONE", 0.5).when(F.coalesce(published, F.lit("")) == "", undated).when(year != "", dated).otherwise(0.5)


def acquisition_cost(url: Column, domain: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    net = F.coalesce(domain, F.lit(""))
    return F.when(U.contains_any(net, COSTLY_HOSTS), 1.8).when(low.endswith(".pdf") | F.contains(low, F.lit("/pdf")), 1.2).when(U.contains_any(net, CHEAP_HOSTS), 0.5).otherwise(1.0)


def lexical_score(df: DataFrame) -> DataFrame:
    """Adds lexical to rows with query, title, snippet, url, provider_rank, providers (array)."""
    asked = V.query_tokens(F.col("query"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    cover = lambda c: V.token_coverage(F.col("_q"), low(c))
    bonus = F.greatest(F.lit(0.0), (6 - F.least("provider_rank", F.lit(5))) * 0.02)
    agreed = F.when(F.size("providers") > 1, 0.10 * (F.size("providers") - 1)).otherwise(0.0)
    score = cover("title") * 0.35 + cover("snippet") * 0.20 + cover("url") * 0.15 + bonus + agreed
    rows = df.withColumn("_q", asked)
    return rows.withColumn("lexical", F.when(F.size("_q") == 0, 0.1).otherwise(F.least(F.lit(1.0), F.round(score, 4)))).drop("_q")


def merge_candidates(df: DataFrame) -> DataFrame:
    """One row per canonical URL from rows (seq, url, title, snippet, provider, provider_rank, source_type,
    published_at, authority_prior, goal_ids, query_variants).

    Providers, goals and variants are united in the order of first sight; the longest title and
    snippet count (the earlier of equally long ones), the best rank, the highest prior; the rest comes
    from the first row by seq. Rows without a URL are dropped, null titles are empty.
    """
    rows = df.where("url is not null").withColumn("canonical", U.canonical_url(F.col("url"))).withColumn("domain", U.authority(F.col("canonical")))
    longest = lambda c: F.max_by(F.trim(F.coalesce(c, F.lit(""))), F.struct(F.length(F.trim(F.coalesce(c, F.lit("")))), -F.col("seq")))
    first = lambda c: F.min_by(c, "seq")
    merged = rows.groupBy("canonical").agg(
        first("url").alias("url"), first("domain").alias("domain"), longest("title").alias("title"), longest("snippet").alias("snippet"),
        first("provider").alias("provider"), F.min("provider_rank").alias("provider_rank"), first("source_type").alias("source_type"), first("published_at").alias("published_at"),
        F.max("authority_prior").alias("authority_prior"), F.min("seq").alias("seq"),
    )
    none = F.array().cast("array<string>")
    for name, values in (("providers", F.array("provider")), ("goal_ids", F.col("goal_ids")), ("query_variants", F.col("query_variants"))):
        seen = rows.select(F.col("canonical").alias("_c"), "seq", F.posexplode(values).alias("pos", "v")).where("v is not null").groupBy("_c", "v").agg(F.min(F.struct("seq", "pos")).alias("at"))
        each = seen.groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(name))
        merged = merged.join(each, F.col("canonical") == F.col("_c"), "left").drop("_c").withColumn(name, F.coalesce(name, none))
    return merged


WEIGHTS = {"lexical": 0.35, "semantic": 0.25, "authority": 0.25, "freshness": 0.10, "agreement": 0.05}


def rank_pool(df: DataFrame, depth: int = 0) -> DataFrame:
    """Adds agreement, diversity, final_score and rank to rows with seq, canonical, domain, providers,
    lexical, semantic, authority, freshness, cost. A domain's bonus shrinks with its earlier rows."""
    n = F.size("providers")
    placed = grouped_positions(df, ["domain"], [F.col("seq")], "_seen")
    rows = placed.withColumns({"agreement": F.when(n > 1, F.least(F.lit(1.0), (n - 1) * 0.5)).otherwise(0.0), "diversity": F.greatest(F.lit(0.0), 0.10 - 0.03 * F.col("_seen"))}).drop("_seen")
    parts = [F.round(F.lit(w) * F.col(c), 4) for c, w in WEIGHTS.items()] + [F.round("diversity", 4), F.lit(-round(0.05 * depth, 4))]
    total = sum(parts[1:], parts[0])
    rows = rows.withColumn("final_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total / (0.8 + 0.2 * F.col("cost")), 4))))
    return grouped_positions(rows, [], [F.desc("final_score"), F.desc("canonical")], "rank").withColumn("rank", F.col("rank") + 1)


def filter_hits(df: DataFrame, wanted: dict[str, str] | None) -> DataFrame:
    """Hits (source_type, goal_ids, url) of a source type, a goal_id and a domain (as part of the address); other keys pass."""
    tests = {"source_type": lambda v: F.col("source_type") == v, "goal_id": lambda v: F.array_contains("goal_ids", v), "domain": lambda v: F.contains("url", F.lit(v))}
    for key, value in (wanted or {}).items():
        df = df.where(tests[key](value)) if key in tests else df
    return df


def filter_payload(df: DataFrame, wanted: dict[str, object] | None) -> DataFrame:
    """Rows whose columns equal all values that aren't null; plain comparisons, which the scan takes over."""
    for key, value in (wanted or {}).items():
        df = df.where(F.col(key) == value) if value is not None else df
    return df


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, most: int = 20) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, id, branch, score): the first ``most`` of each query.

    Ranks are places within query and branch (score descending, id ascending); a branch adds its
    weight (1 if not named) over k + rank. Ties of the score rounded to six places go by id. Adds
    dense_rank and sparse_rank where the branches are called so.
    """
    ranked = grouped_positions(hits.select("query_id", "id", "branch", "score"), ["query_id", "branch"], [F.desc_nulls_last("score"), F.asc("id")], "r").withColumn("r", F.col("r") + 1)
    weight = F.lit(1.0)
    if weights:
        named = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
        weight = F.coalesce(F.try_element_at(named, F.col("branch")), F.lit(0.0))
    each = ranked.groupBy("query_id", "id").agg(
        F.round(F.sum(weight / (k + F.col("r"))), 6).alias("fusion_score"), F.min(F.when(F.col("branch") == "dense", F.col("r"))).alias("dense_rank"), F.min(F.when(F.col("branch") == "sparse", F.col("r"))).alias("sparse_rank")
    )
    placed = grouped_positions(each, ["query_id"], [F.desc("fusion_score"), F.asc("id")], "place")
    return placed.withColumn("place", F.col("place") + 1).where(F.col("place") <= most)


def information_density(text: Column) -> Column:
    """.05 for each kind of empirical statement in a text, at most .2."""
    hits = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in EMPIRICAL_PATTERNS), F.lit(0))
    return F.least(F.lit(0.20), hits * 0.05)


def rerank(df: DataFrame) -> DataFrame:
    """Adds rerank_score to rows with query, title, text, authority_score, fusion_score (nulls: empty, .5, 0)."""
    text, title = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    asked = V.query_tokens(F.col("query"))
    covered = F.size(F.filter(asked, lambda t: F.contains(text, t) | F.contains(title, t))) / F.greatest(F.size(asked), F.lit(1))
    phrase = F.when(F.contains(text, F.lower("query")), 0.2).otherwise(0.0)
    raw = (0.55 * covered + 0.35 * F.coalesce("fusion_score", F.lit(0.0)) + phrase + information_density(F.col("text"))) * (0.8 + 0.2 * F.coalesce("authority_score", F.lit(0.5)))
    return df.withColumn("rerank_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(raw, 4))))


def late_interaction(df: DataFrame) -> DataFrame:
    """Adds late_score to rows with query, text, fusion_score: mean over the query's words of the best
    match among the first 100 words of the text (1 equal, .5 one in the other), averaged with the fusion."""
    asked, read = T.words(F.lower(F.coalesce("query", F.lit("")))), F.slice(T.words(F.lower(F.coalesce("text", F.lit("")))), 1, 100)
    rows = df.withColumns({"_q": asked, "_d": read})
    best = F.transform("_q", lambda q: F.when(F.array_contains("_d", q), 1.0).when(F.exists("_d", lambda w: F.contains(w, q) | F.contains(q, w)), 0.5).otherwise(0.0))
    mean = F.when((F.size("_q") > 0) & (F.size("_d") > 0), F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size("_q")).otherwise(0.0)
    return rows.withColumn("late_score", F.round(0.5 * mean + 0.5 * F.coalesce("fusion_score", F.lit(0.0)), 4)).drop("_q", "_d")


def information_gain(candidates: DataFrame, goals: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds gain to candidates (id, domain, authority_prior, goal_ids) from goals (goal_id, coverage) and covered (domain)."""
    need = candidates.select("id", F.explode("goal_ids").alias("goal_id")).join(goals, "goal_id").groupBy("id").agg(F.sum(1.0 - F.col("coverage")).alias("deficit"))
    seen = covered.select("domain").distinct().withColumn("_seen", F.lit(True))
    rows = candidates.join(need, "id", "left").join(seen, "domain", "left")
    gain = 0.5 + 0.40 * F.coalesce("deficit", F.lit(0.0)) + F.when(F.col("_seen"), -0.15).otherwise(0.20) + F.when(F.col("authority_prior") >= 0.90, 0.10).otherwise(0.0)
    return rows.withColumn("gain", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.round(gain, 3)))).drop("deficit", "_seen")


SELECTED = "query_id string, id string, place int"


def select_diverse(df: DataFrame, most: int = 10, balance: float = 0.7, per_domain: int = 2) -> DataFrame:
    """query_id, id, place: greedy choice by relevance, unlikeness to the chosen and a domain limit.

    ``df`` has query_id, id, url, text, score, place and holds the short list of a query (the first
    ranks, so a group is bounded). With at most ``most`` rows the order stays.
    """
    import pandas as pd

    import re

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        if len(rows) <= most:
            return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "place": range(1, len(rows) + 1)})
        words = [frozenset(re.findall(r"\w+", (t or "").lower())) for t in rows["text"]]
        nets = [u.split("/")[2] if u and "//" in u else "unknown" for u in rows["url"]]
        scores, ids = rows["score"].fillna(0).to_numpy(), rows["id"].tolist()
        left, chosen, used, like = list(range(len(rows))), [], {}, [0.0] * len(rows)
        while left and len(chosen) < most:
            best = max(left, key=lambda i: (balance * scores[i] - (1 - balance) * like[i] - (0.3 if used.get(nets[i], 0) >= per_domain else 0.0), -i))
            left.remove(best)
            chosen.append(best)
            used[nets[best]] = used.get(nets[best], 0) + 1
            for i in left:
                like[i] = max(like[i], len(words[i] & words[best]) / max(1, len(words[i] | words[best])))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": [ids[i] for i in chosen], "place": range(1, len(chosen) + 1)})

    return df.select("query_id", "id", "url", "text", "score", "place").groupBy("query_id").applyInPandas(pick, SELECTED)


def cheapest_backend(df: DataFrame) -> DataFrame:
    """The backend with the least (base + .1 startup) / success of each request (request_id, backend, base_cost, startup_cost, p_success)."""
    cost = (F.col("base_cost") + 0.1 * F.col("startup_cost")) / F.col("p_success")
    return df.groupBy("request_id").agg(F.min_by("backend", F.struct(cost, "backend")).alias("backend"), F.round(F.min(cost), 6).alias("expected_cost"))
