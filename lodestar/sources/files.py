"""File sources: repository files, manifests, commit logs, questions and answer records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.session import cut

#: Size limits in bytes, files named in a commit chunk, commits of a log, characters of history that are embedded.
MOST_SOURCE_BYTES, MOST_GREP_BYTES, MOST_COMMIT_FILES, MOST_COMMITS, MOST_EMBEDDED_HISTORY = 300_000, 1_000_000, 25, 5000, 2_000
QUESTIONS = "id string, repo string, category string, expected string, split string, question string, reference_answer string, key_facts array<string>, gold_evidence array<string>"
ANSWERS = "id string, system string, question string, answer string, abstained boolean, error string, citations array<string>, quotes array<struct<ref:string,quote:string>>, evidence_refs array<string>, usage map<string,bigint>, latency_s double, judgement struct<key_facts:array<struct<fact:string,covered:boolean>>,claims:array<struct<claim:string,supported:boolean>>,contradicts_reference:boolean,notes:string>"


def _decoded(content: Column) -> Column:
    """Bytes as UTF-8; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files under root but version control's own, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = r"^(?:[a-z]+:/*)?/?" + re.escape(root.strip("/")) + "/(.*)$"
    return files.select(F.regexp_extract("path", inside, 1).alias("path"), "length", "content").where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))


def source_files(files: DataFrame) -> DataFrame:
    """(path, language, text) of the files that are indexed as code."""
    return files.where(T.is_source(F.col("path")) & (F.col("length") <= MOST_SOURCE_BYTES)).select("path", T.language_of(F.col("path")).alias("language"), _decoded(F.col("content")).alias("text"))


def document_files(files: DataFrame) -> DataFrame:
    """(path, text) of the files that are indexed as documents; a path is code or a document, not both."""
    return files.where(~T.is_source(F.col("path")) & T.is_document(F.col("path"))).select("path", _decoded(F.col("content")).alias("text"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, text); a line end at the end begins no line."""
    whole = F.regexp_replace("text", r"(?:\r\n|\n|\r)\z", "")
    rows = files.where("text <> ''").select("path", F.posexplode(F.split(whole, "\r\n|\n|\r")).alias("pos", "text"))
    return rows.select("path", (F.col("pos") + 1).alias("line"), "text")


def tracked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files that a listing names (value: a path a line, as version control lists them)."""
    return files.join(manifest.select(F.trim("value").alias("path")).where("path <> ''").distinct(), "path", "left_semi")


def searched_files(files: DataFrame) -> DataFrame:
    """(path, text) of the files whose lines can be searched: UTF-8, and not too large."""
    return files.where((F.col("length") <= MOST_GREP_BYTES) & F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def _records(spark: SparkSession, path: str, most: int) -> tuple[DataFrame, Callable[[int], Column]]:
    """The first records of a log with their place (newest first), and a field of a record by number.

    Places follow the names of the files, the blocks of a file and the rows of a block, whatever the
    order in which tasks read them.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.option("lineSep", "\x1e").text(path).withColumn("place", place).where(F.trim("value") != "").orderBy("place").limit(most)
    return rows, lambda i: F.trim(F.element_at(F.split("value", "\x1f"), i))


def _commit(field: Callable[[int], Column]) -> dict[str, Column]:
    """ref, title, created_at and embed_text of a record."""
    opening = F.concat_ws("\n", F.nullif(field(4), F.lit("")), F.nullif(field(5), F.lit("")))
    return {"ref": F.concat(F.lit("commit:"), F.substring(F.regexp_replace(field(1), r"^\s+", ""), 1, 10)), "title": field(4), "created_at": field(3), "embed_text": F.substring(opening, 1, MOST_EMBEDDED_HISTORY)}


def commit_log(spark: SparkSession, path: str, most: int = MOST_COMMITS) -> DataFrame:
    """Chunks (ref, title, text, created_at, embed_text) of a commit log, newest first as the log has them.

    Records end in RS; fields (hash, author, date, subject, body, files) are parted by US.
    """
    records, field = _records(spark, path, most)
    names = F.filter(F.split(field(6), r"\s*\n\s*"), lambda x: x != "")
    more = F.when(F.size(names) > MOST_COMMIT_FILES, F.concat(F.lit("... and "), F.size(names) - MOST_COMMIT_FILES, F.lit(" more")))
    listed = F.array_join(F.array_compact(F.concat(F.slice(names, 1, MOST_COMMIT_FILES), F.array(more))), "\n")
    own = _commit(field)
    return records.select(own["ref"].alias("ref"), own["title"].alias("title"), F.concat_ws("\n", field(4), field(5), F.concat(F.lit("Files:\n"), listed)).alias("text"), own["created_at"].alias("created_at"), own["embed_text"].alias("embed_text"))


def commit_patches(spark: SparkSession, path: str, most: int = MOST_COMMITS) -> tuple[DataFrame, DataFrame]:
    """(commits, hunks) of a log whose sixth field is the patch, without context lines: commits (seq, ref,
    title, body, created_at), larger seq newer; hunks (path, seq, old_start, old_lines, new_start, new_lines)."""
    records, field = _records(spark, path, most)
    seq = F.lit(most) - F.row_number().over(Window.orderBy("place"))  # at most `most` rows
    rows = cut(records.select(seq.cast("bigint").alias("seq"), *(c.alias(k) for k, c in _commit(field).items() if k != "embed_text"), field(5).alias("body"), field(6).alias("patch")))
    parts = rows.select("seq", F.explode(F.split("patch", r"(?m)^diff --git ")).alias("part")).select("seq", F.regexp_extract("part", r"(?m)^\+\+\+ b/(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^(@@ -\S+ \+\S+ @@)"), F.lit(1))).alias("head"))
    form = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda i, default: F.coalesce(F.regexp_extract("head", form, i).try_cast("bigint"), F.lit(default).cast("bigint"))
    hunks = parts.where("path <> ''").select("path", "seq", number(1, 0).alias("old_start"), number(2, 1).alias("old_lines"), number(3, 0).alias("new_start"), number(4, 1).alias("new_lines"))
    return rows.drop("patch"), hunks


def questions(spark: SparkSession, path: str, ids: list[str] | None = None, split: str | None = None) -> DataFrame:
    """Questions of a JSON array, by ids and split if given."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", "true").json(path)
    rows = rows.where(F.col("id").isin(ids)) if ids else rows
    return rows.where(F.col("split") == split) if split else rows


def answer_records(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each (id, system) of a JSON-lines file that only grows."""
    rows = spark.read.schema(ANSWERS).json(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rest = [c for c in rows.columns if c not in ("id", "system", "_at")]
    best = rows.groupBy("id", "system").agg(F.max_by(F.struct(*rest), "_at").alias("b"))
    return best.select("id", "system", *[F.col(f"b.{c}").alias(c) for c in rest])
