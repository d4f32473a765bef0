"""Streams over event and request tables.

State is kept per key in the state store; time is the events' own, so a replay gives the same rows.
"""

from __future__ import annotations

import atexit
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import remove, shared_dir

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream; ``ts`` becomes a timestamp so that it can carry a watermark."""
    rows = spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the rows it wrote.

    Append goes to Parquet; complete and update go through foreachBatch, each batch to a table of its
    own with the batch number, and the last row of a key is the caller's to pick.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(remove, spark, base)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/{number}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows/*")


def distinct_events(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: at-least-once delivery becomes once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events and sum of values by day and type (an extension: windows on event time)."""
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def totals(stream: DataFrame) -> DataFrame:
    """Running totals by type, for update mode."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


LIMITED = "host string, event_id bigint, rps double, wait double"
BUCKET = "tokens double, last double, rps double"


def rate_limits(stream: DataFrame, rps: float = 2.0) -> DataFrame:
    """Wait and rate of each request (host, event_id, ts, status) of a host.

    A bucket of twice the rate fills with time; a request takes one token or waits for the rest. The
    rate halves on 429 and 503 (not below .5) and grows by a twentieth on success, up to ``rps``.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        tokens, last, rate = state.get if state.exists else (2 * rps, None, rps)
        out = []
        for number, ts, status in zip(rows["event_id"], rows["ts"], rows["status"]):
            now = ts.timestamp()
            tokens = min(2 * rps, tokens + max(0.0, now - (now if last is None else last)) * rate)
            last = now
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens = tokens - 1 if tokens >= 1 else tokens
            rate = max(0.5, rate / 2) if status in (429, 503) else min(rps, rate * 1.05) if 200 <= status < 400 else rate
            out.append((key[0], number, round(rate, 6), round(wait, 6)))
        state.update((tokens, last, rate))
        yield pd.DataFrame(out, columns=["host", "event_id", "rps", "wait"])

    return stream.groupBy("host").applyInPandasWithState(step, LIMITED, BUCKET, "append", "NoTimeout")


LEASES = "domain string, seq bigint, action string, request string, state string, priority double"
QUEUE = "requests array<struct<request:string,state:string,priority:double,seq:bigint,attempt:int,expires:double>>"


def frontier(stream: DataFrame, lease: float = 30.0, active: int = 3, attempts: int = 5, penalty: float = 5.0) -> DataFrame:
    """Decisions of a request queue per domain from commands (domain, seq, ts, action, request, priority).

    add queues a request (again: the higher priority counts); next leases the first by priority and
    age unless ``active`` leases run; done ends one; fail queues it again with less priority, or ends
    it as DEAD after ``attempts``. A lease that has run out (its end at or before now) is queued again.
    An ended request is forgotten, so the state holds what is open; to keep it from coming back put
    ``distinct_events`` before.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        held = {r[0]: list(r) for r in (state.get[0] if state.exists else [])}
        out = []
        for seq, ts, action, request, priority in zip(rows["seq"], rows["ts"], rows["action"], rows["request"], rows["priority"]):
            now = ts.timestamp()
            for r in held.values():
                if r[1] == "LEASED" and r[5] <= now:
                    r[1], r[5] = "QUEUED", 0.0
            found = held.get(request)
            if action == "add":
                if found is None:
                    found = held[request] = [request, "QUEUED", float(priority), int(seq), 1, 0.0]
                elif found[1] == "QUEUED":
                    found[2] = max(found[2], float(priority))
            elif action == "next":
                waiting = [r for r in held.values() if r[1] == "QUEUED"]
                found = None
                if waiting and sum(r[1] == "LEASED" for r in held.values()) < active:
                    found = min(waiting, key=lambda r: (-r[2], r[3]))
                    found[1], found[5] = "LEASED", now + lease
            elif action == "done" and found is not None and found[1] == "LEASED":
                found[1] = "DONE"
            elif action == "fail" and found is not None and found[1] == "LEASED":
                found[4] += 1
                found[1], found[2] = ("DEAD", found[2]) if found[4] > attempts else ("QUEUED", found[2] - penalty)
            out.append((key[0], seq, action, found[0] if found else None, found[1] if found else "NONE", found[2] if found else None))
            if found is not None and found[1] in ("DONE", "DEAD"):
                del held[found[0]]
        state.update(([tuple(r) for r in held.values()],))
        yield pd.DataFrame(out, columns=["domain", "seq", "action", "request", "state", "priority"])

    return stream.groupBy("domain").applyInPandasWithState(step, LEASES, QUEUE, "append", "NoTimeout")


RANKED = "run string, seq bigint, action string, url string, state string, priority double, attempt int, goals array<string>"
CANDIDATES = "clock bigint, items array<struct<url:string,domain:string,goals:array<string>,priority:double,turn:bigint,state:string,attempt:int,expires:double>>"


def ranked_frontier(stream: DataFrame, lease: float = 30.0, active: int = 3, attempts: int = 4, penalty: float = 0.10, floor: float = 0.05, capacity: int = 10_000) -> DataFrame:
    """Decisions of a ranked queue per run from commands (run, seq, ts, action, url, domain, goal, priority).

    add queues a candidate; for a known one it adds the goal and keeps the higher priority; beyond
    ``capacity`` waiting ones it is REFUSED. next leases the first by priority, of equal ones the one
    that came in first, passing over domains with ``active`` leases; if all are, the first of all.
    A lease whose end is before now (not at it) is queued again. retry queues a candidate again with
    less priority (not under ``floor``), or ends it as FAILED at ``attempts``; done and fail end it.
    An ended candidate is forgotten, so the state holds at most ``capacity`` and the open leases.
    """
    waiting_states = ("QUEUED", "RETRY")

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        clock, old = state.get if state.exists else (0, [])
        names = ("url", "domain", "goals", "priority", "turn", "state", "attempt", "expires")
        held = {r[0]: dict(zip(names, r)) | {"goals": list(r[2])} for r in old}
        out = []
        for seq, ts, action, url, domain, goal, priority in zip(rows["seq"], rows["ts"], rows["action"], rows["url"], rows["domain"], rows["goal"], rows["priority"]):
            now, clock = ts.timestamp(), clock + 1
            found = held.get(url)
            told = found["state"] if found else "NONE"
            if action == "add":
                if found is not None:
                    if goal and goal not in found["goals"]:
                        found["goals"].append(goal)
                    if priority > found["priority"]:
                        found["priority"] = float(priority)
                        found["turn"] = clock if found["state"] in waiting_states else found["turn"]
                elif sum(r["state"] in waiting_states for r in held.values()) >= capacity:
                    told = "REFUSED"
                else:
                    found = held[url] = dict(zip(names, (url, domain, [goal] if goal else [], float(priority), clock, "QUEUED", 0, 0.0)))
                    told = "QUEUED"
            elif action == "next":
                for r in held.values():
                    if r["state"] == "LEASED" and r["expires"] < now:
                        r["state"], r["expires"], r["turn"] = "QUEUED", 0.0, clock
                leased = Counter(r["domain"] for r in held.values() if r["state"] == "LEASED")
                order = sorted((r for r in held.values() if r["state"] in waiting_states), key=lambda r: (-r["priority"], r["turn"]))
                found = next((r for r in order if leased[r["domain"]] < active), order[0] if order else None)
                told = "NONE"
                if found is not None:
                    told = found["state"] = "LEASED"
                    found["attempt"], found["expires"] = found["attempt"] + 1, now + lease
            elif found is not None:
                found["expires"] = 0.0
                if action == "retry" and found["attempt"] < attempts:
                    found["state"], found["priority"], found["turn"] = "RETRY", max(floor, found["priority"] - penalty), clock
                    told = "RETRY"
                else:
                    told = "DONE" if action == "done" else "FAILED"
                    del held[url]
            out.append((key[0], seq, action, found["url"] if found else url, told, found and round(found["priority"], 6), found and found["attempt"], list(found["goals"]) if found else None))
        state.update((clock, [tuple(r[n] for n in names) for r in held.values()]))
        yield pd.DataFrame(out, columns=["run", "seq", "action", "url", "state", "priority", "attempt", "goals"])

    return stream.groupBy("run").applyInPandasWithState(step, RANKED, CANDIDATES, "append", "NoTimeout")


def near_duplicates_as_they_come(stream: DataFrame, path: str, distance: int = 3) -> None:
    """Run ``stream`` (id bigint, text) and keep a table of clusters at ``path`` that each batch is joined to.

    Version n of the table is ``path``/n: id, fingerprint, cluster of all rows up to batch n - 1.
    """
    from tessera.operators.dedup import incremental_clusters, simhash

    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        new = simhash(batch, "id")
        known = spark.read.parquet(f"{path}/{number}") if number else spark.createDataFrame([], "id bigint, fingerprint bigint, cluster bigint")
        incremental_clusters(known, new, distance).write.mode("overwrite").parquet(f"{path}/{number + 1}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(add).start().awaitTermination()


BUDGET = "pages bigint, bytes bigint"
SPENT = "job string, seq bigint, admitted boolean, pages bigint, bytes bigint"


def budgets(stream: DataFrame, pages: int, bytes_: int) -> DataFrame:
    """Admission of requests (job, seq, ts, bytes) while a job's budget lasts; a refused request spends nothing."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        n, used = state.get if state.exists else (0, 0)
        out = []
        for seq, size in zip(rows["seq"], rows["bytes"]):
            ok = n + 1 <= pages and used + size <= bytes_
            n, used = (n + 1, used + size) if ok else (n, used)
            out.append((key[0], seq, ok, n, used))
        state.update((int(n), int(used)))
        yield pd.DataFrame(out, columns=["job", "seq", "admitted", "pages", "bytes"])

    return stream.groupBy("job").applyInPandasWithState(step, SPENT, BUDGET, "append", "NoTimeout")
