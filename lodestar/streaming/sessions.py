"""Streams of tool events: repeat suppression, late data, budgets, evidence state, windows, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Tool calls of a session, and how late an event may be.
MOST_CALLS, LATENESS = 15, "1 hour"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def without_repeats(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first call of each session, tool and sorted arguments within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "event_type", "props"])


def before_cutoff(events: DataFrame, cutoff: str) -> DataFrame:
    """Events up to a snapshot's time, itself included; later ones are dropped for good."""
    return events.where(F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """(start, event_type, n, total) of closed windows."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """(user_id, start, stop, n) of sessions that end after a gap."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", lateness).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def within_budget(events: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """The first `most` calls of each session, by a counter in keyed state.

    What a trigger brings of a session comes as several frames in any order, so its first calls are
    known once all of them are read; only those are held.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        left, first = max(0, most - used), None
        for frame in frames:
            used += len(frame)
            frame = frame if first is None else pd.concat([first, frame])
            first = frame.sort_values("event_id", kind="stable").head(left)
        state.update((min(used, 2**31 - 1),))
        if first is not None:
            yield pd.DataFrame({"user_id": first["user_id"], "event_id": first["event_id"]})

    keyed = events.select("user_id", "event_id").groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id bigint, event_id bigint", "used int", "append", GroupStateTimeout.NoTimeout)


def merge_text(old: str | None, new: str, is_code: bool) -> str:
    """The text of a reference after one more entry: code keeps its first, history grows."""
    if old is None or old in new and not is_code:
        return new
    if is_code or new in old:
        return old
    return f"{old}\n...\n{new}"


def evidence(turns: DataFrame) -> DataFrame:
    """(session, ref, text) after each batch: evidence of a reference accumulates in keyed state.

    turns: session, ref, seq, is_code, text.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else None
        for frame in frames:
            for row in frame.sort_values("seq", kind="stable").itertuples():
                text = merge_text(text, row.text, bool(row.is_code))
        if text is not None:
            state.update((text,))
            yield pd.DataFrame({"session": [key[0]], "ref": [key[1]], "text": [text]})

    return turns.groupBy("session", "ref").applyInPandasWithState(run, "session bigint, ref string, text string", "text string", "update", GroupStateTimeout.NoTimeout)


def server_events(events: DataFrame) -> DataFrame:
    """One server-sent event for each row: a data line of JSON."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*[F.col(c) for c in events.columns])), F.lit("\n\n")).alias("line"))


def upsert_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key in numbered versions under path.

    A batch is written once under its own number, so a batch that runs again after a failure does
    not count twice.
    """
    from lodestar.operators.store import last_wins

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number > 0:
            batch = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch)
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/{number}")

    return write
