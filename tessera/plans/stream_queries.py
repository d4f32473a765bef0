"""Streaming operators, replayed over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming import streams


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.replay(streams.totals(streams.events(spark, d)), "complete")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").select("event_type", "n", "errors")


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    twice = streams.events(spark, d)
    return streams.replay(streams.distinct_events(twice.union(twice), ["event_id"], "40 days").select("event_id", "event_type"))


def stream_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.events(spark, d).select(F.col("user_id").cast("string").alias("host"), "event_id", "ts", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))
    return streams.replay(streams.rate_limits(rows))


def stream_frontier(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod("event_id", F.lit(4))
    action = F.element_at(F.array(*[F.lit(a) for a in ("add", "next", "done", "fail")]), (n + 1).cast("int"))
    request = F.concat(F.lit("r"), F.floor(F.col("event_id") / 40).cast("string"))
    rows = streams.events(spark, d).select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("seq"), "ts", action.alias("action"), request.alias("request"), F.round("value", 3).alias("priority"))
    return streams.replay(streams.frontier(rows, lease=86_400.0))


def stream_budgets(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.events(spark, d).select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), "ts", F.pmod("event_id", F.lit(100)).alias("bytes"))
    return streams.replay(streams.budgets(rows, 40, 1500)).select("job", "seq", "admitted")


QUERIES = {f.__name__: f for f in (stream_totals, stream_distinct, stream_rate_limits, stream_frontier, stream_budgets)}

ORACLE = {
    "stream_totals": "select event_type, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by event_type",
    "stream_rate_limits": """with recursive r as (select user_id::varchar as host, event_id, epoch_us(ts) / 1e6 as now, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as k from events),
      f as (select host, event_id, k, now, 3.0::double as tokens, case when bad then 1.0 else 2.0 end::double as rate, 0.0::double as wait from r where k = 1
        union all select host, event_id, k, now, case when a >= 1 then a - 1 else a end, case when bad then greatest(0.5::double, rate / 2) else least(2.0::double, rate * 1.05::double) end, case when a >= 1 then 0 else (1 - a) / rate end
        from (select r.*, f.rate, least(4.0::double, f.tokens + greatest(0.0::double, r.now - f.now) * f.rate) as a from f join r on r.host = f.host and r.k = f.k + 1))
      select host, event_id, round(rate, 6) as rps, round(wait, 6) as wait from f""",
    "stream_budgets": """with recursive r as (select user_id::varchar as job, event_id as seq, (event_id % 100)::bigint as bytes, row_number() over (partition by user_id order by ts, event_id) as k from events),
      f as (select job, seq, k, bytes <= 1500 as ok, case when bytes <= 1500 then 1 else 0 end::bigint as n, case when bytes <= 1500 then bytes else 0 end::bigint as used from r where k = 1
        union all select job, seq, k, ok, n + case when ok then 1 else 0 end, used + case when ok then bytes else 0 end from (select r.*, f.n, f.used, f.n + 1 <= 40 and f.used + r.bytes <= 1500 as ok from f join r on r.job = f.job and r.k = f.k + 1))
      select job, seq, ok as admitted from f""",
    "stream_distinct": "select distinct event_id, event_type from events",
}
