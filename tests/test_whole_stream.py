"""Repeat suppression keeps one event of each key, and the query shows it."""

from datetime import datetime, timedelta

from lodestar import catalog
from lodestar.plans import stream_queries
from lodestar.streaming import sessions


def test_kept_events(spark, tmp_path):
    began, folder = datetime(2024, 1, 1), str(tmp_path / "in")
    rows = [(i, began + timedelta(seconds=i), u, k, 1.0, p) for i, (u, k, p) in enumerate([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (1, "b", "x"), (1, "a", "y"), (1, "a", "x"), (2, "a", "x")])]
    spark.createDataFrame(rows, sessions.EVENTS).coalesce(1).write.parquet(folder)
    kept = stream_queries.drained(sessions.without_repeats(spark.readStream.schema(sessions.EVENTS).parquet(folder))).collect()
    assert sorted(r["event_id"] for r in kept) == [0, 2, 3, 4]


def test_query_shows_repeats(spark, data, monkeypatch):
    assert {r["n"] for r in stream_queries.stream_repeat_suppression(spark, data).collect()} == {1}
    events = [tuple(r) for r in spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_type", "props").collect()]
    monkeypatch.setattr(sessions, "without_repeats", lambda rows: rows)
    got = stream_queries.stream_repeat_suppression(spark, data).collect()
    assert {tuple(r)[:3]: r["n"] for r in got} == {k: events.count(k) for k in events} and max(r["n"] for r in got) > 1


def test_tables_in_folders_and_without_rows(spark, data, tmp_path):
    """What Spark writes is a folder of parts; a table without rows gives no rows."""
    rows = spark.read.parquet(f"{data}/events.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/full/events.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    for name in ("stream_cutoff", "stream_call_budget"):
        query = catalog.queries()[name]
        assert query(spark, f"{tmp_path}/full").count() == query(spark, data).count() > 0
        assert query(spark, f"{tmp_path}/none").count() == 0
