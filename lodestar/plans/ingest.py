"""Ingest: files and history of a repository into chunks, symbols, calls, postings and vectors, then one swap."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking as C
from lodestar.operators import inverted, ivf
from lodestar.operators import ranges as G
from lodestar.operators.embedding import Embedder, EmbeddingCache, HashingEmbedder
from lodestar.operators.store import Snapshot, Store, first_wins
from lodestar.repositories import Register
from lodestar.session import cut
from lodestar.sources import code, files

COLUMNS = ["kind", "ref", "path", "start_line", "end_line", "symbol", "title", "text", "created_at", "parent", "embed_text", "extra"]
#: Characters of code and documents that are embedded; kinds that are cut into passages.
MOST_EMBEDDED, CUT_KINDS = 4_000, ("issue", "pr", "discussion", "release")
#: Seconds for which the files of replaced states stay readable.
GRACE = 3_600.0


def _shaped(rows: DataFrame) -> DataFrame:
    kinds = {"start_line": "int", "end_line": "int", "extra": "array<string>"}
    for c in COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None))
        rows = rows.withColumn(c, F.col(c).cast(kinds.get(c, "string")))
    return rows.select(*COLUMNS)


def _texts(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans (span_id, path, start, end, ...) with the text of their lines."""
    hits = G.points_in(lines, spans.select("span_id", "path", "start", "end"))
    text = hits.groupBy("span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return spans.join(text, "span_id")


def definition_spans(found: DataFrame) -> DataFrame:
    """(path, symbol, label, extra, start, end) of definitions (path, name, qualified_name, kind, start_line, end_line, depth).

    A definition that holds others gives its head, up to the first of them, with their names as extra
    terms; any other gives windows of all its lines.
    """
    held = found.where("depth > 0").select(F.col("path").alias("p"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("above"), F.col("depth").alias("d"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("member"))
    key = ["path", "qualified_name", "kind", "start_line", "end_line"]
    inside = F.expr("path = p AND qualified_name = above AND d = depth + 1 AND s >= start_line AND e <= end_line")
    joined = found.select(*key, "depth").join(held, inside, "left").select(*key, "s", "member")
    members = F.transform(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "member")))), lambda x: x["member"])
    whole = joined.groupBy(*key).agg(F.min("s").alias("first"), members.alias("extra"))
    start, end = F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint")
    head = F.array(F.struct(start.alias("start"), F.greatest(start, F.least(F.col("first") - 1, start + C.WINDOW_LINES - 1)).alias("end")))
    spans = F.when(F.col("first").isNotNull(), head).otherwise(C.line_windows(start, end))
    return whole.select("path", F.col("qualified_name").alias("symbol"), F.col("kind").alias("label"), "extra", F.explode(spans).alias("w")).select("path", "symbol", "label", "extra", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def code_chunks(sources: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, symbols, calls) of source files: heads and windows of definitions, and module-level runs."""
    found = cut(code.definitions(sources))
    top = found.where("depth = 0").select(F.monotonically_increasing_id().alias("def_id"), "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    own = lines.join(sources.select("path"), "path", "left_semi")
    none = F.lit(None).cast("string")
    runs = C.islands(G.outside(own, top, "line")).select("path", none.alias("symbol"), none.alias("label"), F.array().cast("array<string>").alias("extra"), F.explode(C.line_windows(F.col("start").cast("bigint"), F.col("end").cast("bigint"))).alias("w")).select("path", "symbol", "label", "extra", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    spans = cut(definition_spans(found).unionByName(runs).withColumn("span_id", F.monotonically_increasing_id()))
    ref = F.concat("path", F.lit(":"), "start", F.lit("-"), "end")
    context = F.concat_ws("\n", "path", F.concat("label", F.lit(" "), "symbol"), "text")
    told = F.when(F.size("extra") > 0, F.concat(F.lit("\nmembers: "), F.array_join("extra", ", "))).otherwise("")
    embedded = F.concat(F.substring(context, 1, MOST_EMBEDDED), told)
    chunks = _shaped(_texts(spans, own).select(F.lit("code").alias("kind"), ref.alias("ref"), "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "symbol", "text", embedded.alias("embed_text"), "extra"))
    raw = code.calls(sources).withColumn("call_id", F.monotonically_increasing_id())
    named = found.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("qualified_name").alias("def_id"))
    sites = G.innermost(cut(raw), named, "call_id").select("callee", F.coalesce("def_id", F.lit("<module>")).alias("caller"), "path", "line")
    return chunks, found.drop("depth"), sites


def document_chunks(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks of documents: heading sections, small ones carried forward, long ones cut at blank lines."""
    own = lines.join(documents.select("path"), "path", "left_semi")
    sections = C.sections(own)
    merged = C.merge_small(C.sized(sections, own).select("path", "title", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "size"))
    spans = cut(C.split_long(merged, own).withColumn("span_id", F.monotonically_increasing_id()))
    ref = F.concat("path", F.lit(":"), "start", F.lit("-"), "end")
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    out = _texts(spans, own).withColumn("text", text).where("text <> ''")
    return _shaped(out.select(F.lit("doc").alias("kind"), ref.alias("ref"), "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "title", "text", F.substring(F.concat_ws("\n", "path", "title", "text"), 1, MOST_EMBEDDED).alias("embed_text")))


def history_chunks(history: DataFrame) -> DataFrame:
    """Chunks of commits, threads and releases, and passages of long threads."""
    threads = _shaped(history)
    long_ = threads.where(F.col("kind").isin(*CUT_KINDS)).select(F.col("ref").alias("id"), F.col("text").alias("body"))
    passages = C.passages(long_).select(F.lit("passage").alias("kind"), F.concat("id", F.lit("@"), "offset").alias("ref"), "text", F.col("id").alias("parent"))
    return threads.unionByName(_shaped(passages))


@dataclass(frozen=True)
class Pinned:
    """One state of a repository's index: what it reads does not change while it is used."""

    spark: SparkSession
    state: Snapshot
    embedder: Embedder
    repo: str

    def pinned(self) -> Pinned:
        return self

    def read(self, name: str) -> DataFrame:
        return self.state.read(name, self.repo)

    def has(self, name: str) -> bool:
        return self.state.has(name, self.repo)

    def lexical(self) -> inverted.InvertedIndex:
        """Full text search over all repositories' statistics; filter hits by repo."""
        return inverted.InvertedIndex(self.state)


@dataclass
class Index:
    """The tables of ingested repositories under one folder, swapped in together.

    repo names the repository that is read and, unless told otherwise, ingested; a folder may hold many,
    and those that an ingest does not name keep their files.
    """

    spark: SparkSession
    folder: str
    embedder: Embedder = field(default_factory=HashingEmbedder)
    repo: str = ""
    on_stage: Callable[[str], None] = lambda message: None

    @property
    def store(self) -> Store:
        return Store(self.spark, self.folder)

    @property
    def register(self) -> Register:
        return Register(self.spark, self.folder)

    def pinned(self) -> Pinned:
        """The current state."""
        return Pinned(self.spark, self.store.snapshot(), self.embedder, self.repo)

    def read(self, name: str) -> DataFrame:
        return self.pinned().read(name)

    def clear(self) -> None:
        """Drops all tables of the repository, in one swap; its entry in the register stays."""
        self.store.publish(dict.fromkeys(self.store.snapshot().tables), self.repo)

    def ingest(self, root: str, history: DataFrame | None = None, tracked: str | None = None, patches: str | None = None, grace: float = GRACE) -> dict[str, int]:
        """Builds all tables of the files under root, then swaps them in; a failure leaves the old ones.

        history: chunks of commits, threads and releases, if there are any. tracked: a text file that names
        the files to take, one a line; patches: a commit log with patches, for line history. Stages are
        noted in the register, states replaced more than grace seconds ago are swept. Returns chunks by kind.
        """
        began, register, store = time.monotonic(), self.register, self.store
        base = store.snapshot()

        def stage(message: str) -> None:
            self.on_stage(message)
            register.note(self.repo, status="ingesting", stage=message)

        try:
            stage("Reading files")
            found = files.repository_files(self.spark, root)
            found = cut(found if tracked is None else files.tracked(found, self.spark.read.text(tracked)))
            sources, documents = cut(files.source_files(found)), cut(files.document_files(found))
            lines = cut(files.file_lines(sources.select("path", "text").unionByName(documents)))
            searched = files.file_lines(files.searched_files(found))
            made = {"lines": store.write("lines", lines), "searched": store.write("searched", searched)}
            stage("Cutting chunks")
            chunks, symbols, calls = code_chunks(sources, lines)
            parts = [chunks, document_chunks(documents, lines)] + ([] if history is None else [history_chunks(history)])
            arrived = [rows.withColumn("arrival", F.struct(F.lit(i).alias("i"), F.coalesce("start_line", F.lit(0)).alias("line"), F.coalesce("symbol", "title", F.lit("")).alias("name"))) for i, rows in enumerate(parts)]
            every = arrived[0]
            for rows in arrived[1:]:
                every = every.unionByName(rows)
            kept = first_wins(every, ["ref"], "arrival").drop("arrival")
            rows = cut(kept.withColumn("repo", F.lit(self.repo)).withColumn("id", F.xxhash64("repo", "ref")))
            made |= {"symbols": store.write("symbols", symbols), "calls": store.write("calls", calls)}
            if patches is not None:
                commits, hunks = files.commit_patches(self.spark, patches)
                made |= {"commits": store.write("commits", commits), "hunks": store.write("hunks", hunks)}
            else:
                made |= dict.fromkeys(("commits", "hunks"))  # none of this state
            cache = EmbeddingCache(self.spark, f"{self.folder}/cache", self.embedder)
            told = rows.withColumn("embed_text", F.when(F.col("kind") != "passage", F.coalesce("embed_text", "text")))
            stage("Embedding chunks")
            cache.ensure(told.select(F.col("embed_text").alias("text")), lambda done, total: stage(f"Embedding chunks ({done}/{total} rounds)"))
            stage("Writing index")
            made["chunks"] = store.write("chunks", cache.with_vectors(told, "embed_text").drop("embed_text"))
            body = T.search_body(*(F.col(c) for c in ("title", "symbol", "path", "text", "extra")))
            made |= inverted.build(rows.select("id", body.alias("body"), "kind", "repo"), store)
            made |= ivf.build(store.read_version(made["chunks"]).select("id", "vector", "kind"), store)
            now = store.publish(made, self.repo, base)
            counts = {r["kind"]: r["count"] for r in now.read("chunks", self.repo).groupBy("kind").count().collect()}
            stats = {**counts, "symbols": now.read("symbols", self.repo).count(), "ingest_seconds": round(time.monotonic() - began)}
            register.note(self.repo, status="ready", stage="Ready", error="", stats=json.dumps(stats))
        except Exception as error:
            register.note(self.repo, status="failed", stage="Failed", error=f"{type(error).__name__}: {error}"[:1_000])
            raise
        store.sweep(grace)
        return counts
