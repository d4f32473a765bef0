"""Retrieval metrics, telemetry, health, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.positions import grouped_positions, grouped_sums

BROWSER, HTTP, API = ("L3_BROWSER", "L4_SEMANTIC", "L5_VISUAL", "browser"), ("L1_HTTP", "http"), ("L2_API", "api")


def retrieval_metrics(retrieved: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg at ``k``, six places.

    ``retrieved`` has query_id, id, rank (from 1); ``grades`` has query_id, id, grade; a grade above
    0 is relevant. A query without relevant ids has recall 1. The ideal order is the grades' own.
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    good = grades.where("grade > 0").groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    top = retrieved.where(F.col("rank") <= k).join(good, ["query_id", "id"], "left").na.fill(0, ["grade"])
    seen = top.groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("hits"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg")
    )
    ideal = grouped_positions(good, ["query_id"], [F.desc("grade"), F.asc("id")], "p")
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("p") < k, gain(F.col("grade"), F.col("p") + 1))).alias("idcg"))
    rows = retrieved.select("query_id").distinct().join(seen, "query_id", "left").join(best, "query_id", "left").na.fill(0, ["hits", "relevant"])
    r6 = lambda c: F.round(c, 6)
    return rows.select(
        "query_id", r6(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(1.0)).alias("recall"), r6(F.col("hits") / k).alias("precision"),
        r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), r6(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
    )


def diversity(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, kinds, diversity: Shannon entropy of the values over its maximum (0 for one value)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    entropy = F.log2("n") - F.col("nlog") / F.col("n")
    return total.select(group, "n", "kinds", F.round(F.when(F.col("kinds") > 1, entropy / F.log2("kinds")).otherwise(0.0), 6).alias("diversity"))


def domain_stats(df: DataFrame) -> DataFrame:
    """domain, attempts, successes, blocks, timeouts, avg_latency, success_rate from rows (domain, success, blocked, timeout, latency)."""
    out = df.groupBy("domain").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.count_if("blocked").alias("blocks"), F.count_if("timeout").alias("timeouts"), F.round(F.avg("latency"), 6).alias("avg_latency"))
    return out.withColumn("success_rate", F.round(F.col("successes") / F.col("attempts"), 2))


def ewma(df: DataFrame, keys: list[str], alpha: float = 0.2) -> DataFrame:
    """keys, attempts, ewma: exponentially weighted mean of value in the order of ts, seq; the first value starts it.

    The closed form needs only each row's distance from the end of its group, so rows of one key are
    weighted where they are and summed with a partial step.
    """
    rows = grouped_positions(df.where("value is not null"), keys, [F.col("ts").desc(), F.col("seq").desc()], "back")
    sizes = rows.groupBy(*keys).agg((F.max("back")).alias("last"))
    rows = rows.join(sizes, keys)
    weight = F.pow(F.lit(1 - alpha), F.col("back")) * F.when(F.col("back") == F.col("last"), 1.0).otherwise(alpha)
    return rows.groupBy(*keys).agg(F.count("*").alias("attempts"), F.round(F.sum(weight * F.col("value")), 6).alias("ewma"))


def success_probability(attempts, successes):
    """Held to .05..0.99; .95 with fewer than three attempts."""
    return F.when(F.coalesce(attempts, F.lit(0)) < 3, 0.95).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), successes / attempts)))


def provider_health(df: DataFrame) -> DataFrame:
    """provider, calls, errors, candidates, error_rate, factor from rows (provider, error, candidates)."""
    out = df.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.sum("candidates").alias("candidates"))
    rate = F.col("errors") / F.col("calls")
    return out.withColumn("error_rate", F.round(rate, 6)).withColumn("factor", F.when((rate >= 0.8) & (F.col("calls") >= 3), 0.2).when(rate >= 0.5, 0.6).otherwise(1.0))


def telemetry(df: DataFrame) -> DataFrame:
    """One row of totals from rows (strategy, bytes, useful_bytes, retries, ts): counts, escalation per cent, useful share, rate."""
    of = lambda names: F.count_if(F.col("strategy").isin(*names))
    out = df.agg(
        F.count("*").alias("total_requests"), of(HTTP).alias("http_requests"), of(BROWSER).alias("browser_requests"), of(API).alias("api_requests"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries_total"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("useful_bytes"), F.lit(0)).alias("useful_bytes"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"),
    )
    share = F.when(F.col("total_requests") > 0, F.col("browser_requests") / F.col("total_requests") * 100).otherwise(0.0)
    useful = F.when(F.col("total_bytes") > 0, F.col("useful_bytes") / F.col("total_bytes")).otherwise(0.0)
    seconds = F.greatest(F.lit(0.1), F.coalesce("span", F.lit(0)) / 1e6)
    return out.select("total_requests", "http_requests", "browser_requests", "api_requests", "retries_total", "total_bytes", "useful_bytes", F.round(share, 2).alias("escalation_percent"), F.round(useful, 4).alias("useful_ratio"), F.round(F.col("total_requests") / seconds, 6).alias("per_second"))


def run_rates(df: DataFrame) -> DataFrame:
    """run, documents, rejected, duplicates, chunks and the shares a run's evaluation reports, from rows (run, rejected, duplicate, chunks)."""
    out = df.groupBy("run").agg(F.count("*").alias("documents"), F.count_if("rejected").alias("rejected"), F.count_if("duplicate").alias("duplicates"), F.sum("chunks").alias("chunks"))
    pct = lambda c: F.round(100 * F.col(c) / F.col("documents"), 6)
    return out.select("run", "documents", "rejected", "duplicates", "chunks", pct("rejected").alias("rejected_percent"), pct("duplicates").alias("duplicate_percent"), F.round(F.col("chunks") / F.col("documents"), 6).alias("chunks_per_document"))


def quality_gate(one: DataFrame, direct: float = 0.80, blocked: float = 0.0) -> DataFrame:
    """Adds gate and failures to one row with direct_rate, block_rate, status."""
    failures = F.filter(
        F.array(F.when(F.col("direct_rate") < direct, "DIRECT_EVIDENCE_RATE"), F.when(F.col("block_rate") > blocked, "BLOCK_RATE"), F.when(F.col("status") != "SUFFICIENT_EVIDENCE", "STATUS")), lambda x: x.isNotNull()
    )
    return one.withColumn("failures", failures).withColumn("gate", F.size("failures") == 0)


ADMISSION = "job string, seq bigint, admitted boolean, reason string"
REQUEST = {"bytes": "bigint", "depth": "int", "ts": "double", "browser_seconds": "double", "visual": "boolean", "llm_tokens": "bigint"}


def admit(df: DataFrame, pages: int, bytes_: int, depth: int, browser_seconds: float | None = None, visual_pages: int | None = None, llm_tokens: int | None = None, deadline: float | None = None) -> DataFrame:
    """job, seq, admitted, reason: requests (job, seq and what of REQUEST is there) taken in order while the budget lasts.

    The checks, in this order: DEADLINE, DEPTH, PAGES, BYTES, BROWSER (of requests that need one), VISUAL,
    TOKENS; limits of None don't count. A refused request uses nothing up, so later smaller ones may
    still pass: a fold over the requests of each job in the order of seq. The rows of a job pass in
    batches of a sorted partition and only the totals are kept, so a job may have any number of them.
    """
    import pandas as pd

    def fold(parts):
        job, n, used, seconds, visuals, tokens = None, 0, 0, 0.0, 0, 0
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.job != job:
                    job, n, used, seconds, visuals, tokens = r.job, 0, 0, 0.0, 0, 0
                reason = None
                if deadline is not None and r.ts > deadline:
                    reason = "DEADLINE"
                elif r.depth > depth:
                    reason = "DEPTH"
                elif n + 1 > pages:
                    reason = "PAGES"
                elif used + r.bytes > bytes_:
                    reason = "BYTES"
                elif browser_seconds is not None and r.browser_seconds > 0 and seconds + r.browser_seconds > browser_seconds:
                    reason = "BROWSER"
                elif visual_pages is not None and r.visual and visuals + 1 > visual_pages:
                    reason = "VISUAL"
                elif llm_tokens is not None and r.llm_tokens > 0 and tokens + r.llm_tokens > llm_tokens:
                    reason = "TOKENS"
                else:
                    n, used, seconds, visuals, tokens = n + 1, used + r.bytes, seconds + r.browser_seconds, visuals + bool(r.visual), tokens + r.llm_tokens
                out.append((r.job, r.seq, reason is None, reason))
            yield pd.DataFrame(out, columns=["job", "seq", "admitted", "reason"])

    zero = {name: F.coalesce(F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind), F.lit(False) if kind == "boolean" else F.lit(0).cast(kind)).alias(name) for name, kind in REQUEST.items()}
    rows = df.select(F.col("job").cast("string").alias("job"), F.col("seq").cast("bigint").alias("seq"), *zero.values())
    return rows.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(fold, ADMISSION)


def running_totals(df: DataFrame) -> DataFrame:
    """Running count and sum of bytes of each job in the order of seq, and the mean so far (null bytes count in neither sum nor mean)."""
    known = F.col("bytes").isNotNull().cast("bigint")
    rows = grouped_sums(df.select("job", "seq", "bytes"), ["job"], [F.col("seq")], {"n": F.lit(1).cast("bigint"), "total": F.col("bytes"), "known": known})
    return rows.select("job", "seq", "n", F.when(F.col("known") > 0, F.col("total")).alias("total"), F.round(F.col("total") / F.nullif("known", F.lit(0)), 6).alias("mean"))


def latency_sample(df: DataFrame, most: int = 100) -> DataFrame:
    """host, samples, mean_latency over the newest ``most`` responses (host, seq, latency) of each host."""
    newest = grouped_positions(df, ["host"], [F.desc("seq")], "_p").where(F.col("_p") < most)
    return newest.groupBy("host").agg(F.count("*").alias("samples"), F.round(F.avg("latency"), 6).alias("mean_latency"))


def activity_ratios(df: DataFrame) -> DataFrame:
    """activity, items, success_ratio, unique_ratio, density from rows (activity, ok, key, weight): shares of rows that
    succeeded and of keys that differ, and the mean weight; six places."""
    out = df.groupBy("activity").agg(F.count("*").alias("items"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_ratio"), F.round(F.count_distinct("key") / F.count("*"), 6).alias("unique_ratio"), F.round(F.avg("weight"), 6).alias("density"))
    return out


def reason_histogram(df: DataFrame) -> DataFrame:
    """run, kind, value, n: rejections (run, provider, reason) counted by reason and by provider."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("reason", "provider")]))
    return df.select("run", kinds.alias("x")).where("x.value is not null").groupBy("run", "x.kind", "x.value").agg(F.count("*").alias("n"))


def trace_events(df: DataFrame, entity: str | None = None, kind: str | None = None) -> DataFrame:
    """The events (entity_id, event_type, ...) of one entity, of one type, or of both."""
    for name, value in (("entity_id", entity), ("event_type", kind)):
        df = df.where(F.col(name) == value) if value is not None else df
    return df


def event_history(df: DataFrame, most: int = 500) -> DataFrame:
    """What a late subscriber is sent first: the newest ``most`` events (job, seq, ...) of each job, with place from the oldest of them."""
    newest = grouped_positions(df, ["job"], [F.desc("seq")], "_p").where(F.col("_p") < most).drop("_p")
    return grouped_positions(newest, ["job"], [F.asc("seq")], "place")


def first_pages(df: DataFrame, most: int) -> DataFrame:
    """Early stop: the first ``most`` pages (run, seq, ok) of each run that were taken well, with place."""
    return grouped_positions(df.where("ok"), ["run"], [F.asc("seq")], "place").where(F.col("place") < most)


class CapabilityUnavailable(RuntimeError):
    """A capability that a step needs is unknown or switched off."""


def require(capabilities: dict[str, str], name: str) -> str:
    """The state of a capability; an error where it is unknown or "disabled"."""
    state = capabilities.get(name, "unknown")
    if state in ("unknown", "disabled"):
        raise CapabilityUnavailable(f"{name}: {state}")
    return state


def domain_turns(df: DataFrame, most: int = 3) -> DataFrame:
    """seq, domain, priority, turn: requests in order of priority, at most ``most`` of a domain first, the rest of it after all others."""
    placed = grouped_positions(df, ["domain"], [F.desc("priority"), F.asc("seq")], "_p")
    placed = placed.withColumn("spill", F.col("_p") >= most).drop("_p")
    return grouped_positions(placed, [], [F.asc("spill"), F.desc("priority"), F.asc("seq")], "turn")
