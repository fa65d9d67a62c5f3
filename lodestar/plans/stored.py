"""Indexes of the given tables, built once in the shared folder and found again by what they were built from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators.store import Snapshot, Store
from lodestar.session import scratch


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and times of the files at path; changes when the table does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{{,/*}}"))
    files = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)
    return hashlib.sha256(repr((path, files)).encode()).hexdigest()[:24]


def stored(spark: SparkSession, sf_dir: str, table: str, kind: str, make: Callable[[Store], dict[str, str]]) -> Snapshot:
    """The snapshot of what make(store) wrote for a table of sf_dir; it is written at the first call alone."""
    store = Store(spark, f"{scratch(spark)}/stored/{kind}-{table}-{fingerprint(spark, f'{sf_dir}/{table}.parquet')}")
    now = store.snapshot()
    return now if now.number else store.publish(make(store))


def rows_of(build: Callable, rows: DataFrame) -> Callable[[Store], dict[str, str]]:
    """make for `stored`: build(rows, store)."""
    return lambda store: build(rows, store)
