"""Store semantics as DataFrame operations, a versioned table, and a store that swaps all its tables at once."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an upsert by replay."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the non-null fields of changes (at most one row a key)."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def missing(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of wanted that are not held: cache misses, or work left to do."""
    return wanted.select(*keys).distinct().join(held.select(*keys), keys, "left_anti")


def cached(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys are held."""
    return wanted.join(held.select(*keys).distinct(), keys, "left_semi")


def recovered(repos: DataFrame) -> DataFrame:
    """repos after a restart: what was queued or under way has failed."""
    return repos.withColumn("status", F.when(F.col("status").isin("queued", "ingesting"), "failed").otherwise(F.col("status")))


class VersionedTable:
    """Parquet versions in a folder that all executors share, and a pointer to the current one.

    A new version is written whole before the pointer moves, so readers see the old or the new one
    and a failed write leaves the old one. All access goes through Hadoop's file system.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """Name of the current version."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))] if self._fs.exists(self._path(self.folder)) else []
        marks = sorted(n for n in names if n.startswith("_current."))
        return marks[-1].split(".", 2)[2] if marks else None

    def prepare(self, rows: DataFrame) -> str:
        """Writes a version that no reader sees yet."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        return version

    def activate(self, version: str) -> None:
        """Makes a prepared version the current one and drops older ones."""
        if not self._fs.exists(self._path(f"{self.folder}/{version}/_SUCCESS")):
            raise ValueError(f"{version} is not whole")
        old = self.current()
        marks = [s.getPath() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("_current.")]
        number = 1 + max([int(m.getName().split(".")[1]) for m in marks], default=0)
        self._fs.create(self._path(f"{self.folder}/_current.{number:012d}.{version}"), False).close()
        for mark in marks:
            self._fs.delete(mark, False)
        if old:
            self.discard(old)

    def discard(self, version: str) -> None:
        """Drops a version."""
        self._fs.delete(self._path(f"{self.folder}/{version}"), True)

    def read(self) -> DataFrame:
        """The current version."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        return self.spark.read.parquet(f"{self.folder}/{version}")


#: Seconds after which the claim of a job that publishes counts as that of a lost one.
CLAIM = 600


@dataclass(frozen=True)
class Snapshot:
    """One state of a store: the versions of every table's parts. What it reads does not change."""

    store: Store
    number: int
    tables: dict[str, dict[str, str]]

    def has(self, name: str, part: str = "") -> bool:
        """Whether a part of a table is there."""
        return part in self.tables.get(name, {})

    def read(self, name: str, part: str | None = None) -> DataFrame:
        """A table: all its parts, or the one asked for."""
        parts = self.tables.get(name, {})
        paths = list(parts.values()) if part is None else [parts[part]] if part in parts else []
        if not paths:
            raise FileNotFoundError(f"no {name}{f' of {part}' if part else ''} in {self.store.folder}")
        return self.store.spark.read.parquet(*[f"{self.store.folder}/{p}" for p in paths])


class Store:
    """Parquet tables under one folder that executors share, with one manifest for all of them.

    A table has parts (one for each repository, say), a part has versions, and a manifest names the
    version of every part. Versions are written whole before a manifest names them; making a manifest
    the current one is the creation of one empty file. So a reader sees all tables before a swap or all
    of them after it, whatever fails in between, and a snapshot taken before it can still be read
    until its versions are swept. Parts that a swap does not name keep their files. One job publishes
    at a time; a second one that began from the same state is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str = "") -> list:
        path = self._path(f"{self.folder}/{folder}" if folder else self.folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self) -> list[tuple[int, str, int]]:
        """(number, name, time in ms) of the manifests that were made current, oldest first."""
        marks = [(s.getPath().getName(), s.getModificationTime()) for s in self._listed() if s.getPath().getName().startswith("_current.")]
        return sorted((int(n.split(".")[1]), n.split(".", 2)[2], at) for n, at in marks)

    def _tables(self, name: str) -> dict[str, dict[str, str]]:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0])

    def snapshot(self) -> Snapshot:
        """The current state; an empty one if nothing was published."""
        found = self._manifests()
        return Snapshot(self, found[-1][0], self._tables(found[-1][1])) if found else Snapshot(self, 0, {})

    def write(self, name: str, rows: DataFrame) -> str:
        """Writes a version of a part of table name; no snapshot has it until it is published."""
        version = f"{name}/v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{version}")
        return version

    def read_version(self, version: str) -> DataFrame:
        """A version that may not be published yet."""
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def discard(self, version: str) -> None:
        """Deletes a version that was not published and is not going to be."""
        self._fs.delete(self._path(f"{self.folder}/{version}"), True)

    def publish(self, changes: dict[str, str | None], part: str = "", base: Snapshot | None = None) -> Snapshot:
        """Swaps in versions by table name, for one part, all at once; None drops the part of a table.

        base: the state that the versions were made from; RuntimeError if another was published since.
        """
        now = self.snapshot()
        if base is not None and base.number != now.number:
            raise RuntimeError(f"state {now.number} was published since state {base.number}")
        for version in filter(None, changes.values()):
            if not self._fs.exists(self._path(f"{self.folder}/{version}/_SUCCESS")):
                raise ValueError(f"{version} is not whole")
        tables = {name: dict(parts) for name, parts in now.tables.items()}
        for name, version in changes.items():
            tables.setdefault(name, {}).pop(part, None)
            if version is not None:
                tables[name][part] = version
        name = f"manifest-{uuid.uuid4().hex}.json"
        out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        try:
            out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        finally:
            out.close()
        # Of two jobs that got here together each sees the other's claim, or the other's state; none of
        # those goes on. A claim that a lost job left is void after CLAIM seconds.
        number, claims = now.number + 1, f"_claim.{now.number + 1:012d}."
        claim = self._path(f"{self.folder}/{claims}{name}")
        self._fs.create(claim, False).close()
        try:
            others = [s for s in self._listed() if s.getPath().getName().startswith(claims) and s.getModificationTime() > (time.time() - CLAIM) * 1000]
            found = self._manifests()
            if len(others) > 1 or (found[-1][0] if found else 0) != now.number:
                raise RuntimeError("another job publishes from the same state")
            self._fs.create(self._path(f"{self.folder}/_current.{number:012d}.{name}"), False).close()
        finally:
            self._fs.delete(claim, False)
        return Snapshot(self, now.number + 1, tables)

    def sweep(self, grace: float) -> list[str]:
        """Deletes what no state of the last grace seconds names, and tells what went.

        A state counts from when the next one replaced it. Versions that are not published and younger
        than that stay: a job may be about to publish them. What is left of failed jobs goes.
        """
        limit, found = (time.time() - grace) * 1000, self._manifests()
        old = [(n, name) for (n, name, _), (_, _, replaced) in zip(found, found[1:], strict=False) if replaced <= limit]
        kept = {name for _, name, _ in found} - {name for _, name in old}
        named = {v for name in kept for parts in self._tables(name).values() for v in parts.values()}
        gone = []
        for number, name in old:
            gone += [f"_current.{number:012d}.{name}", name]
        for status in self._listed():
            own = status.getPath().getName()
            if status.isDirectory():
                gone += [f"{own}/{v.getPath().getName()}" for v in self._listed(own) if f"{own}/{v.getPath().getName()}" not in named and v.getPath().getName().startswith("v-") and v.getModificationTime() <= limit]
            elif own.startswith(("manifest-", "_claim.")) and own not in kept and own not in gone and status.getModificationTime() <= limit:
                gone.append(own)
        for name in gone:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return gone
