"""Row-batch helpers for operators that run Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes that a step gets at once.
BATCH_ROWS, BATCH_BYTES = 500, 2_000_000
#: Spark's own batches are larger (64 MB): too much where every core runs one. The setting holds for
#: the session; batches of narrow rows, 10,000 at most, stay below it and are as before.
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """The process's object of this key, made at the first call; it outlives a task, but only one is held."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _release(keep: str | None) -> None:
    """Drops what other operators hold in this worker, and gives unused memory back.

    What stays forgets what it gathered in a task, if it can: an executor has more workers than
    tasks at a time, and they take turns, so each would hold as much as the one at work.
    """
    if any(k != keep for k in _HELD):
        _HELD.clear()
        gc.collect()
    for own in _HELD.values():
        if forget := getattr(own, "forget", None):
            forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes, one row at least."""
    rows = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, holds: str | None = None) -> DataFrame:
    """mapInArrow with per-task state. holds: key of what make() takes by held().

    make() runs once in a task and returns a function from a record batch to a dict of column lists,
    or None for no rows. Column types come from schema, so nulls and empty batches are typed.
    """
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_SETTING, BATCH_BYTES)
    kinds: StructType = _parse_datatype_string(schema)
    types = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(holds)
        step = make()
        for batch in chain.from_iterable(map(_parts, batches)):
            out = step(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in types], schema=types)
        del step
        _release(holds)

    return df.mapInArrow(run, kinds)
