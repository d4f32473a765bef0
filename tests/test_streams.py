from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.streaming import streams


def stream_of(spark, tmp_path, rows, schema, parts=2):
    """A file stream that delivers the rows in ``parts`` batches."""
    path = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_rate_limits(spark, tmp_path):
    rows = [("h", i, at(0), 200) for i in range(5)] + [("h", 5, at(0), 429), ("h", 6, at(10), 200)]
    out = streams.replay(streams.rate_limits(stream_of(spark, tmp_path, rows, "host string, event_id bigint, ts timestamp, status int", 1), rps=2.0)).orderBy("event_id").collect()
    assert [r.wait for r in out] == [0, 0, 0, 0, 0.5, 0.5, 0]
    assert out[5].rps == 1.0 and out[6].rps == 1.05


def test_frontier(spark, tmp_path):
    steps = [("add", "a", 50.0, 0), ("add", "b", 70.0, 0), ("add", "a", 60.0, 1), ("next", None, 0.0, 2), ("fail", "b", 0.0, 3), ("next", None, 0.0, 4), ("next", None, 0.0, 5), ("done", "a", 0.0, 6), ("next", None, 0.0, 40)]
    rows = [("d", i, at(t), action, request, priority) for i, (action, request, priority, t) in enumerate(steps)]
    out = streams.replay(streams.frontier(stream_of(spark, tmp_path, rows, "domain string, seq bigint, ts timestamp, action string, request string, priority double", 1))).orderBy("seq").collect()
    got = [(r.action, r.request, r.state, r.priority) for r in out]
    assert got == [
        ("add", "a", "QUEUED", 50.0), ("add", "b", "QUEUED", 70.0), ("add", "a", "QUEUED", 60.0), ("next", "b", "LEASED", 70.0), ("fail", "b", "QUEUED", 65.0), ("next", "b", "LEASED", 65.0),
        ("next", "a", "LEASED", 60.0), ("done", "a", "DONE", 60.0), ("next", "b", "LEASED", 65.0),
    ]


def test_ranked_frontier(spark, tmp_path):
    steps = [
        ("add", "low", "a", "g1", 0.2, 0), ("add", "high", "b", "g1", 0.9, 0), ("add", "low", "a", "g2", 0.1, 0), ("next", None, None, None, 0.0, 1), ("next", None, None, None, 0.0, 1), ("next", None, None, None, 0.0, 31),
        ("retry", "high", None, None, 0.0, 31), ("next", None, None, None, 0.0, 32), ("next", None, None, None, 0.0, 32), ("done", "low", None, None, 0.0, 33), ("fail", "none", None, None, 0.0, 33),
        *[("retry", "high", None, None, 0.0, 34), ("next", None, None, None, 0.0, 34)] * 3,
    ]
    rows = [("r", i, at(t), action, url, domain, goal, priority) for i, (action, url, domain, goal, priority, t) in enumerate(steps)]
    out = streams.replay(streams.ranked_frontier(stream_of(spark, tmp_path, rows, "run string, seq bigint, ts timestamp, action string, url string, domain string, goal string, priority double", 2))).orderBy("seq").collect()
    got = [(r.action, r.url, r.state, r.priority, r.attempt) for r in out]
    assert got[:11] == [
        ("add", "low", "QUEUED", 0.2, 0), ("add", "high", "QUEUED", 0.9, 0), ("add", "low", "QUEUED", 0.2, 0), ("next", "high", "LEASED", 0.9, 1), ("next", "low", "LEASED", 0.2, 1), ("next", None, "NONE", None, None),
        ("retry", "high", "RETRY", 0.8, 1), ("next", "high", "LEASED", 0.8, 2), ("next", "low", "LEASED", 0.2, 2), ("done", "low", "DONE", 0.2, 2), ("fail", "none", "NONE", None, None),
    ]
    assert out[2].goals == ["g1", "g2"] and got[11:] == [("retry", "high", "RETRY", 0.7, 2), ("next", "high", "LEASED", 0.7, 3), ("retry", "high", "RETRY", 0.6, 3), ("next", "high", "LEASED", 0.6, 4), ("retry", "high", "FAILED", 0.6, 4), ("next", None, "NONE", None, None)]


def test_ranked_frontier_holds_domains_back(spark, tmp_path):
    rows = [("r", i, at(0), "add", f"u{i}", "d" if i < 4 else "e", None, 1 - i / 10) for i in range(5)] + [("r", 5 + i, at(1), "next", None, None, None, 0.0) for i in range(5)]
    out = streams.replay(streams.ranked_frontier(stream_of(spark, tmp_path, rows, "run string, seq bigint, ts timestamp, action string, url string, domain string, goal string, priority double", 1), capacity=5))
    assert [r.url for r in out.where("action = 'next'").orderBy("seq").collect()] == ["u0", "u1", "u2", "u4", "u3"]


def test_clusters_of_a_stream(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (2, "some other text about maps and archives"), (3, long + " more"), (4, None), (5, "some other text about maps and archives")]
    path = str(tmp_path / "out")
    streams.near_duplicates_as_they_come(stream_of(spark, tmp_path, rows, "id bigint, text string", 3), path)
    assert {r.id: r.cluster for r in spark.read.parquet(f"{path}/3").collect()} == {1: 1, 2: 2, 3: 1, 5: 2}


def test_budget_state_lasts_over_batches(spark, tmp_path):
    rows = [("j", i, at(i), b) for i, b in enumerate([60, 60, 40, 0, 0])]
    out = streams.replay(streams.budgets(stream_of(spark, tmp_path, rows, "job string, seq bigint, ts timestamp, bytes bigint", 2), 3, 100))
    assert sum(r.admitted for r in out.collect()) == 3 and out.agg(F.max("bytes").alias("b")).first().b <= 100


def test_windows_and_duplicates(spark, tmp_path):
    rows = [(1, at(0), "click", 1.0), (1, at(0), "click", 1.0), (2, at(100), "view", 2.0), (3, at(86_400 * 5), "view", 3.0)]
    source = stream_of(spark, tmp_path, rows, "event_id bigint, ts timestamp, event_type string, value double", 1)
    assert streams.replay(streams.distinct_events(source, ["event_id"])).count() == 3
    days = streams.replay(streams.daily_counts(source))
    assert {(r.event_type, r.n) for r in days.collect()} >= {("click", 2), ("view", 1)}
