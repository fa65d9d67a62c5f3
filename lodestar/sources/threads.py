"""A batch data source for threads and releases behind a paged interface.

The transport is a callable in an importable module, `package.module:function`, of (kind, cursor,
size) that returns {"nodes": [...], "next": cursor or None} or raises Heavy when a page is too heavy. So the
connector runs without a network in tests, and on executors by import.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lodestar.functions import text as T

#: Kinds in the order in which they share the budget, page size, characters of a thread, and of its opening that are embedded.
KINDS, PAGE, LEAST_PAGE, MOST_CHARS, MOST_EMBEDDED = ("release", "issue", "pr", "discussion"), 25, 6, 30_000, 2_000
SCHEMA = "kind string, kind_order int, seq int, number bigint, tag string, title string, body string, created_at string, merged_at string, closed_at string, author string, answer string, answer_author string, comments array<struct<author:string,body:string>>"


class Heavy(Exception):
    """The page was too much for the service; a smaller one may pass."""


class RateLimited(Exception):
    """The service asks for a pause."""


#: Attempts at a page that is rate limited; each waits longer.
ATTEMPTS = 4


def fetch(call: Callable, kind: str, cutoff: str | None) -> Iterator[dict]:
    """All nodes of a kind, newest first; pages halve while they are too heavy, late nodes are dropped."""
    cursor, size = None, PAGE
    while True:
        try:
            page = call(kind, cursor, size)
        except Heavy:
            if size <= LEAST_PAGE:
                raise
            size //= 2
            continue
        for node in page["nodes"]:
            if cutoff is None or node["createdAt"] <= cutoff:
                yield node
        cursor = page["next"]
        if cursor is None:
            return


def _row(kind: int, seq: int, n: dict) -> tuple:
    """A row of SCHEMA from a node."""
    who = lambda x: ((x or {}).get("author") or {}).get("login")
    answer = n.get("answer") or {}
    comments = [(who(c), c.get("body")) for c in (n.get("comments") or {}).get("nodes", [])]
    return KINDS[kind], kind, seq, n.get("number"), n.get("tagName"), n.get("title") or n.get("name"), n.get("body") or n.get("description"), n["createdAt"], n.get("mergedAt"), n.get("closedAt"), who(n), answer.get("body"), who(answer), comments


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.transport, self.cutoff = options["transport"], options.get("cutoff")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(KINDS))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        call = getattr(importlib.import_module(module), name)
        kind = KINDS[partition.value]
        for seq, n in enumerate(fetch(call, kind, self.cutoff)):
            yield _row(partition.value, seq, n)


class _Stream(SimpleDataSourceStreamReader):
    """One page a batch: an offset is a kind, a cursor, the rows of the kind so far and what is left of the budget.

    The kinds follow one another, so the budget is theirs in order; a batch that runs again asks for the
    page of its own offset, with the size that its first run settled on.
    """

    def __init__(self, options: dict):
        module, _, name = options["transport"].partition(":")
        self.call, self.cutoff = getattr(importlib.import_module(module), name), options.get("cutoff")
        self.budget, self.wait = int(options.get("most", 10**9)), float(options.get("waitseconds", 30))

    def initialOffset(self) -> dict:
        return {"kind": 0, "cursor": None, "seq": 0, "left": self.budget, "size": PAGE}

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        kind, size, attempt = KINDS[at["kind"]], at["size"], 0
        while True:
            try:
                page = self.call(kind, at["cursor"], size)
                break
            except Heavy:
                if size <= LEAST_PAGE:
                    raise
                size //= 2
            except RateLimited:
                attempt += 1
                if attempt == ATTEMPTS:
                    raise
                time.sleep(self.wait * attempt)
        nodes = [n for n in page["nodes"] if self.cutoff is None or n["createdAt"] <= self.cutoff][: at["left"]]
        rows = [_row(at["kind"], at["seq"] + i, n) for i, n in enumerate(nodes)]
        left, seq = at["left"] - len(rows), at["seq"] + len(rows)
        if page["next"] is None:
            return rows, {"kind": at["kind"] + 1, "cursor": None, "seq": 0, "left": left, "size": PAGE}
        return rows, {"kind": at["kind"], "cursor": page["next"], "seq": seq, "left": left, "size": size}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        while not rows and at["kind"] < len(KINDS) and at["left"] > 0:  # a page may have nothing that is early enough
            rows, at = self._page(at)
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, at = [], start
        while at != end and at["kind"] < len(KINDS) and at["left"] > 0:
            found, at = self._page(at)
            rows += found
        return iter(rows)


class ThreadSource(DataSource):
    """spark.read.format("lodestar_threads").option("transport", "module:function").load()

    Or readStream, a page a batch, with most (threads in all) and waitSeconds after the first rate
    limit: a query that failed goes on at the page where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_threads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def within_budget(threads: DataFrame, most: int) -> DataFrame:
    """The first `most` threads, kinds in their order: what comes last is starved if the budget binds."""
    counts = threads.groupBy("kind_order").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("kind_order").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.select("kind_order", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("used"))  # a row for each kind
    return threads.join(F.broadcast(room), "kind_order").where(F.col("seq") + F.col("used") < most).drop("used")


def thread_chunks(threads: DataFrame) -> DataFrame:
    """(kind, ref, title, text, created_at) of threads and releases."""
    who = lambda c: F.coalesce(c, F.lit("ghost"))
    state = F.when(F.col("kind") == "pr", F.when(F.col("merged_at").isNotNull(), "merged").when(F.col("closed_at").isNotNull(), "closed").otherwise("open"))
    ref = F.when(F.col("kind") == "release", F.concat(F.lit("release:"), "tag")).otherwise(F.concat(F.when(F.col("kind") == "pr", "PR").otherwise(F.col("kind")), F.lit("#"), "number"))
    head = F.concat_ws(" ", ref, F.concat(F.lit("("), state, F.lit(")")), F.coalesce("title", F.lit("")), F.concat(F.lit("by "), who(F.col("author"))))
    answer = F.when(F.col("answer").isNotNull(), F.concat(F.lit("--- accepted answer by "), who(F.col("answer_author")), F.lit(":\n"), T.without_comments(F.col("answer"))))
    comments = F.transform(F.coalesce("comments", F.array().cast("array<struct<author:string,body:string>>")), lambda c: F.concat(F.lit("--- "), F.coalesce(c["author"], F.lit("ghost")), F.lit(":\n"), T.without_comments(c["body"])))
    parts = F.array_compact(F.concat(F.array(head, F.nullif(T.without_comments(F.col("body")), F.lit("")), answer), comments))
    opening = F.concat(F.when(F.col("kind") == "release", "Release ").otherwise(""), F.coalesce("title", F.lit("")), F.lit("\n"), T.without_comments(F.col("body")))
    return threads.select("kind", ref.alias("ref"), "title", F.substring(F.array_join(parts, "\n\n"), 1, MOST_CHARS).alias("text"), "created_at", F.substring(opening, 1, MOST_EMBEDDED).alias("embed_text"))


def recorded(path: str) -> Callable:
    """A transport over a recorded file {kind: [[node, ...], ...]}: one inner list a page."""
    with open(path, encoding="utf-8") as file:
        pages = json.load(file)

    def call(kind: str, cursor, size: int) -> dict:
        at = cursor or 0
        own = pages.get(kind, [])
        return {"nodes": own[at] if at < len(own) else [], "next": at + 1 if at + 1 < len(own) else None}

    return call
