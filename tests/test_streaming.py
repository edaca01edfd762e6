"""The feed replayed as a stream gives the batch answers."""

import datetime

from stockloom.operators import audit
from stockloom.streaming import feed

SCHEMA = "event_id long, ts timestamp, user_id long, status string, kind string"


def write_feed(spark, path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    e = [(i, t(i * (3 if i % 10 else 15)), i % 4, "unread" if i % 3 else "read", "feedback") for i in range(60)]
    e.append((999, t(100_000), 9, "read", "notice"))  # moves the watermark on
    df = spark.createDataFrame(e, SCHEMA)
    df.coalesce(1).write.parquet(f"{path}/1")
    df.where("event_id < 20").coalesce(1).write.mode("append").parquet(f"{path}/1")  # delivered twice
    return df


def test_distinct_events_and_sessions_equal_batch(spark, tmp_path):
    df = write_feed(spark, str(tmp_path))
    stream = feed.distinct_events(feed.read_feed(spark, f"{tmp_path}/1", df.schema))
    seen = []
    feed.refresh(stream, lambda b, i: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(seen) == sorted(r.event_id for r in df.collect())

    out = str(tmp_path / "sessions")
    sessions = feed.feed_sessions(feed.read_feed(spark, f"{tmp_path}/1", df.schema).where("event_id < 999 OR true"), "8 seconds")
    feed.refresh(sessions, lambda b, i: b.write.mode("append").parquet(out), str(tmp_path / "c2")).awaitTermination(120)
    twice = df.union(df.where("event_id < 20"))
    want = sorted((r.user_id, r.first_at, r.n_events) for r in audit.sessions(twice, 8).collect() if r.user_id != 9)
    got = sorted((r.user_id, r.first_at, r.n_events) for r in spark.read.parquet(out).collect() if r.user_id != 9)
    assert got == want


def test_unread_counts(spark):
    df = spark.createDataFrame([("unread", "a"), ("read", "a"), ("unread", "b")], "status string, kind string")
    assert sorted((r.kind, r.unread) for r in feed.unread_counts(df).collect()) == [("a", 1), ("b", 1)]
