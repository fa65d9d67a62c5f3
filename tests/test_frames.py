"""Rows of a key that come in parts, in any order, are taken together."""

import random

from pyspark.sql import functions as F

from lodestar.operators import chunking, retrieval
from lodestar.plans import stream_queries
from lodestar.streaming import sessions


def test_budget_over_frames_in_any_order(spark, tmp_path, monkeypatch):
    """A session's first calls stand in any of the frames of a trigger."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(400).select((400 - F.col("id")).alias("event_id"), F.lit(None).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("x").alias("props"))
    rows.coalesce(1).write.parquet(folder := str(tmp_path / "in"))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        kept = stream_queries.drained(sessions.within_budget(spark.readStream.schema(sessions.EVENTS).parquet(folder), 15)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(tuple(r) for r in kept) == sorted((i % 2, i) for i in range(1, 31))


def test_long_sections_of_paths_that_were_grouped(spark):
    """Sections and blank lines of a path meet, though both were dealt by path before and one side is then read as it was written."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "40k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k, None) for k in conf}
    lines = spark.range(40 * 100).select(F.concat(F.lit("f"), (F.col("id") / 100).cast("int")).alias("path"), (F.col("id") % 100 + 1).alias("line")).withColumn("text", F.when(F.col("line") % 17 == 5, " ").otherwise("x"))
    whole = lines.groupBy("path").agg(F.lit(1).cast("bigint").alias("start"), F.max("line").alias("end"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = chunking.split_long(whole, lines).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted((r["path"], r["start"], r["end"]) for r in got) == sorted((f"f{p}", a, b) for p in range(40) for a, b in ((1, 56), (57, 100)))


def test_definitions_in_one_order(spark):
    """Definitions that begin on one line are given in one order, however the rows lie."""
    rows = [("f", "a.B.f", "a", 1, end) for end in range(40)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        found = retrieval.find_definitions(spark.createDataFrame(rows, "name string, qualified_name string, path string, start_line int, end_line int"), "B.f").collect()
        assert [r["end_line"] for r in found] == list(range(10))
