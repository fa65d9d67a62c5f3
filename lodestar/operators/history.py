"""Line history: ranges of lines followed back through the hunks of commits.

A range is mapped from the newest commit to the oldest: a hunk that overlaps it makes its commit part of
the history, and the range goes on in the text before that commit, moved by what earlier hunks of the
commit added or removed and widened to the old lines of hunks at its ends. It ends at the commit that
brought all its lines. Each step needs the one after it, so the commits of one path are one stream,
in order, in one task; the asked ranges of a path are spread over as many streams as they need, and a
stream holds its ranges and one commit's hunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut, together

#: Asked ranges of one stream, and how many commits of each are told.
ASKED, LIMIT = 20_000, 10


def step_back(start: np.ndarray, end: np.ndarray, hunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(touched, start, end) of ranges before a commit with hunks (old_start, old_lines, new_start, new_lines), in order of new_start.

    A hunk of no new lines stands after its new_start, one of no old lines after its old_start. A range
    that begins in the commit has an end before its start.
    """
    old, n_old, new, n_new = hunks.T
    # Lines are even numbers, so that what was deleted between two of them has a place.
    low, high = 2 * new + (n_new == 0), 2 * (new + n_new - 1) + np.where(n_new == 0, 3, 0)
    moved = np.append(0, np.cumsum(n_old - n_new))
    at = np.searchsorted(high, 2 * start)  # hunks that end before the range
    last = np.searchsorted(low, 2 * end, side="right")  # and those that begin before its end
    bounded = np.minimum(at, len(low) - 1)
    touched = (at < len(low)) & (low[bounded] <= 2 * end)
    first_in = (at < len(low)) & (low[bounded] <= 2 * start)
    before = np.maximum(last - 1, 0)
    last_in = (last > 0) & (high[before] >= 2 * end)
    new_start = np.where(first_in, old[bounded] + (n_old[bounded] == 0), start + moved[at])
    new_end = np.where(last_in, old[before] + np.maximum(n_old[before] - 1, 0), end + moved[last])
    return touched, new_start, new_end


def line_history(asked: DataFrame, hunks: DataFrame, limit: int = LIMIT, asked_together: int = ASKED) -> DataFrame:
    """(ask_id, n, seq, start, end): the newest `limit` commits that changed each asked range, newest first.

    asked: ask_id (integer), path, start, end, in the newest text. hunks: path, seq (larger is newer),
    old_start, old_lines, new_start, new_lines, as unified diffs without context have them. start and end are
    the range in the text that the commit made. Paths without hunks have no history.
    """
    counts = cut(asked.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / asked_together).cast("bigint").alias("streams")))
    name = asked.schema["ask_id"].dataType.simpleString()
    own = asked.join(counts, "path").select("path", F.pmod(F.xxhash64("ask_id"), F.col("streams")).alias("stream"), F.lit(None).cast("bigint").alias("seq"), F.col("ask_id").cast("bigint").alias("ask_id"), *(F.col(c).cast("bigint").alias(k) for c, k in (("start", "a"), ("end", "b"))), *(F.lit(0).cast("bigint").alias(k) for k in ("c", "d")))
    spread = hunks.join(counts, "path").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("streams") - 1)).alias("stream"), F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("ask_id"), *(F.col(c).cast("bigint").alias(k) for c, k in (("old_start", "a"), ("old_lines", "b"), ("new_start", "c"), ("new_lines", "d"))))
    ordered = together(own.unionByName(spread), "path", "stream").sortWithinPartitions("path", "stream", F.col("seq").desc_nulls_first(), "c", "a", "ask_id")
    types = pa.schema([(c, pa.int64()) for c in ("ask_id", "n", "seq", "start", "end")])

    class Stream:
        """The ranges of one path that are still followed, and the hunks of the commit at hand."""

        def __init__(self, key: tuple):
            self.key, self.asked, self.hunks, self.seq, self.state = key, [], [], None, None

        def closed(self) -> list[pa.RecordBatch]:
            """What the commit at hand adds, once all its hunks are there."""
            if self.state is None and self.asked:
                table = np.array(self.asked, dtype=np.int64)
                self.state = [table[:, 0], np.zeros(len(table), dtype=np.int64), table[:, 1], table[:, 2]]
            if not self.hunks or self.state is None or not len(self.state[0]):
                self.hunks = []
                return []
            ids, n, start, end = self.state
            touched, before, upto = step_back(start, end, np.array(self.hunks, dtype=np.int64))
            self.hunks = []
            n = n + touched
            out = [pa.RecordBatch.from_arrays([pa.array(x[touched]) for x in (ids, n, np.full(len(ids), self.seq), start, end)], schema=types)] if touched.any() else []
            going = (before <= upto) & (n < limit)
            self.state = [x[going] for x in (ids, n, before, upto)]
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream: Stream | None = None
        for batch in batches:
            for path, number, seq, ask_id, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("path", "stream", "seq", "ask_id", "a", "b", "c", "d")), strict=True):
                if stream is None or stream.key != (path, number):
                    yield from stream.closed() if stream else ()
                    stream = Stream((path, number))
                if ask_id is not None and seq is None:
                    stream.asked.append((ask_id, a, b))
                    continue
                if seq != stream.seq:
                    yield from stream.closed()
                    stream.seq = seq
                stream.hunks.append((a, b, c, d))
        yield from stream.closed() if stream else ()

    found = ordered.mapInArrow(run, "ask_id bigint, n bigint, seq bigint, start bigint, end bigint")
    return found.withColumn("ask_id", F.col("ask_id").cast(name))
