"""Retrieval: BM25, dense top-k, reciprocal rank fusion, history search, symbols, grep and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import vectors as V

#: BM25 and fusion constants, candidates of each retriever.
K1, B, IDF_FLOOR, RRF_K, CANDIDATES = 1.2, 0.75, 1e-6, 60, 50


def postings(chunks: DataFrame) -> DataFrame:
    """(id, term, tf, dl) from chunks (id, text): one row for each distinct term of a chunk."""
    terms = chunks.select("id", T.tokens(F.col("text")).alias("terms")).select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return terms.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl) over all chunks, whatever a search filters by."""
    return chunks.select(F.size(T.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id, score) of every chunk that has a term of a question.

    chunks: id, text. questions: query_id, term (distinct pairs). Only postings of the asked terms
    are kept before any shuffle, and statistics are over all chunks.
    """
    asked = F.broadcast(questions.select("term").distinct())  # terms of typed questions: a few hundred
    sizes = chunks.select("id", T.tokens(F.col("text")).alias("terms")).select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    hits = sizes.join(asked, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats, df = corpus_statistics(chunks), hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(stats).select("term", "avgdl", F.when(raw <= 0, IDF_FLOOR).otherwise(raw).alias("idf"))  # one row of statistics
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(weight), "term").join(F.broadcast(questions), "term")
    return scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term) of questions (query_id, text); a question without terms gives none."""
    return questions.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term"))


def ranked(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The best k rows of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, list, id, rank): (query_id, id, score)."""
    return lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, one_pass: int = V.ONE_PASS) -> DataFrame:
    """(query_id, id, score, rank): the k vectors with the largest dot product for each query.

    vectors: id, vector; queries: query_id, vector. Each task keeps its own best k, so only k rows
    for each query and task are shuffled. Null vectors are left out; ties go to the smaller id.
    """
    return ranked(V.candidates(vectors, queries, k, one_pass), k)


def regroup(hits: DataFrame, k: int) -> DataFrame:
    """History hits by thread: (query_id, thread, id, score, rank), best hit of each thread, k threads.

    hits: query_id, id, thread, is_passage, score. A thread stands at its best hit's place and shows
    its best passage if it has one.
    """
    first = Window.partitionBy("query_id", "thread").orderBy(F.desc("score"), "id")
    shown = Window.partitionBy("query_id", "thread").orderBy(F.desc("is_passage"), F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = hits.withColumns({"n": F.row_number().over(first), "shown_id": F.first("id").over(shown)}).where("n = 1")
    return ranked(rows.select("query_id", "thread", "id", "shown_id", "score"), k)


def grep(lines: DataFrame, pattern: str, most: int = 40) -> DataFrame:
    """(path, line, text, total) of the first matches in order of path and line; total counts all."""
    hits = lines.where(F.col("text").rlike(pattern))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("path", "line").limit(most).crossJoin(F.broadcast(total)).select("path", "line", F.substring(F.trim("text"), 1, 200).alias("text"), "total")


def find_definitions(symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Symbols whose short name is the last part of name and whose qualified name ends in name, or name in it.

    All namesakes are tested before the limit; where none fits, the first namesakes are given. Rows that
    are equal in name, path and start_line stand in order of their other columns.
    """
    bare = name.strip().strip("`").split("(")[0]
    short = bare.split(".")[-1]
    order = (F.length("qualified_name"), "qualified_name", "path", "start_line", *sorted(set(symbols.columns) - {"name", "qualified_name", "path", "start_line"}))
    fits = F.col("qualified_name").endswith(bare) | F.lit(bare).endswith(F.col("qualified_name"))
    best = symbols.where(F.col("name") == short).withColumn("fits", fits).orderBy(F.desc("fits"), *order).limit(limit)
    some = F.max("fits").over(Window.partitionBy(F.lit(0)))  # at most limit rows, those that fit first
    return best.withColumn("some", some).where(F.col("fits") | ~F.col("some")).drop("fits", "some").orderBy(*order)


def find_callers(calls: DataFrame, name: str, limit: int = 30) -> DataFrame:
    """Call sites of a name, first ones in order of path and line."""
    return calls.where(F.col("callee") == name.strip("`").split("(")[0].split(".")[-1]).orderBy("path", "line", "caller").limit(limit)


def read_lines(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """(line, text) of a clamped line range of one path."""
    low = max(1, start)
    return lines.where((F.col("path") == path.removeprefix("./")) & F.col("line").between(low, max(low, end))).select("line", "text").orderBy("line")
