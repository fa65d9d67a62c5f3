"""Streaming operators run to completion over a table's file as an available-now stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.registry import Registry
from lodestar.session import scratch
from lodestar.streaming import sessions as S

R = Registry()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input and reads what it wrote."""
    spark = stream.sparkSession
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")  # an input without rows gives no batch
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")


def stream(spark, d: str, name: str, schema: str) -> DataFrame:
    """A table as a stream: a file, or a folder of part files."""
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as a plain path must be a folder


def events(spark, d: str) -> DataFrame:
    return stream(spark, d, "events", S.EVENTS)


_HOURS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@R.query(f"SELECT * FROM ({_HOURS}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling_windows(spark, d):
    out = drained(S.tumbling(events(spark, d)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 15")
def stream_call_budget(spark, d):
    return drained(S.within_budget(events(spark, d)))


@R.query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")
def stream_cutoff(spark, d):
    return drained(S.before_cutoff(events(spark, d), "2024-01-15 00:00:00").select("event_id"))


@R.query("SELECT user_id, event_type, props, count(DISTINCT event_type) AS n FROM events GROUP BY ALL")
def stream_repeat_suppression(spark, d):
    out = drained(S.without_repeats(events(spark, d)))
    return out.groupBy("user_id", "event_type", "props").agg(F.count(F.lit(1)).alias("n"))


@R.query()
def stream_sessions(spark, d):
    """Sessions that the watermark has closed."""
    return drained(S.sessions(events(spark, d)))


@R.query()
def stream_evidence(spark, d):
    """Evidence state over the turns of conversations; equals evidence_merge after one batch."""
    turns = stream(spark, d, "conversations", "conv_id bigint, turn bigint, role string, text string")
    k = F.col("turn")
    return drained(S.evidence(turns.select(F.col("conv_id").alias("session"), F.concat(F.lit("ref"), k % 3).alias("ref"), k.alias("seq"), (k % 3 == 0).alias("is_code"), "text")), "update")


@R.query("SELECT event_id, concat('data: {\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}', chr(10), chr(10)) AS line FROM events")
def stream_server_events(spark, d):
    rows = events(spark, d).select("event_id", "event_type")
    line = S.server_events(rows)
    return drained(line).select(F.get_json_object(F.substring("line", 7, 1_000_000), "$.event_id").cast("bigint").alias("event_id"), "line")
