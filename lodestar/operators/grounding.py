"""Grounding: citations resolved against an evidence ledger, quotes, answer checks, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.ranges import BLOCK

#: Shortest quote, shortest abbreviated hash, characters of evidence in a fallback.
MIN_QUOTE, MIN_SHA, BUDGET = 20, 7, 40_000


def resolve(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations (session, cite_id, ref) with the evidence that backs them: how, resolved, seq.

    evidence: session, seq, ref, path, start_line, end_line. An exact reference (in any case) comes
    first, then an abbreviated commit, then a line range inside a seen one, first seen first. Each
    way is an equality join; ranges meet by blocks of lines.
    """
    asked = citations.withColumn("want", T.normal_ref(F.col("ref")))
    ev = evidence.select("session", "seq", F.col("ref").alias("e_ref"), F.col("path").alias("e_path"), "start_line", "end_line")
    # Of equal references and of equal ranges only the first seen can be the answer.
    first = ev.groupBy("session", F.lower("e_ref").alias("low")).agg(F.min(F.struct("seq", "e_ref")).alias("f"))
    exact = asked.withColumn("low", F.lower("want")).join(first, ["session", "low"]).select("session", "cite_id", F.lit(1).alias("way"), F.col("f.seq").alias("seq"), F.col("f.e_ref").alias("resolved"))
    short = F.substring(F.lower("want"), 8, MIN_SHA)
    sha, e_sha = F.substring(F.lower("want"), 8, 100), F.substring(F.lower("e_ref"), 8, 100)
    commits = ev.where(F.lower("e_ref").startswith("commit:")).withColumn("head", F.substring(F.lower("e_ref"), 8, MIN_SHA))
    near = asked.where(F.lower("want").startswith("commit:") & (F.length("want") >= 7 + MIN_SHA)).withColumn("head", short)
    commit = near.join(commits, ["session", "head"]).where(e_sha.startswith(sha) | sha.startswith(e_sha)).select("session", "cite_id", F.lit(2).alias("way"), "seq", F.col("e_ref").alias("resolved"))
    path, start, end = T.ref_range(F.col("want"))
    spans = asked.select("session", "cite_id", path.alias("path"), start.alias("s"), end.alias("e")).where("path is not null and s <= e").withColumn("block", F.floor(F.col("s") / BLOCK))
    seen = ev.where("start_line is not null").groupBy("session", "e_path", "start_line", "end_line").agg(F.min("seq").alias("seq")).withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / BLOCK), F.floor(F.col("end_line") / BLOCK)))).withColumnRenamed("e_path", "path")
    inside = spans.join(seen, ["session", "path", "block"]).where("start_line <= s and e <= end_line").select("session", "cite_id", F.lit(3).alias("way"), "seq", F.concat("path", F.lit(":"), "s", F.lit("-"), "e").alias("resolved"))
    best = exact.unionByName(commit).unionByName(inside).groupBy("session", "cite_id").agg(F.min(F.struct("way", "seq", "resolved")).alias("b"))
    return citations.join(best, ["session", "cite_id"], "left").select(*citations.columns, F.col("b.resolved").alias("resolved"), F.col("b.seq").alias("seq"), F.col("b.way").alias("way"))


def quote_checks(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """quotes (session, cite_id, ref, quote) with supported: long enough and word for word in the evidence.

    evidence as for resolve, with text.
    """
    found = resolve(quotes, evidence).join(evidence.select("session", "seq", "text"), ["session", "seq"], "left")
    needle = T.quote_form(F.col("quote"))
    fits = (F.length(needle) >= MIN_QUOTE) & F.contains(T.quote_form(F.col("text")), needle)
    return found.select("session", "cite_id", F.coalesce(fits, F.lit(False)).alias("supported"))


def answer_problems(answers: DataFrame) -> DataFrame:
    """answers with problems ARRAY<STRING>, empty if the answer is acceptable.

    answers: question, answer, citations, unresolved (arrays of references), abstained,
    n_quotes, bad_quotes (array of references).
    """
    bad = F.array_sort(F.array_distinct(F.filter(T.markers(F.col("answer")), lambda m: (m < 1) | (m > F.size("citations")))))
    parts = F.concat(
        F.transform("unresolved", lambda r: F.concat(F.lit("unresolved citation "), r)),
        F.when(~F.col("abstained") & (F.size("citations") == 0), F.array(F.lit("no citation"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(bad) > 0, F.array(F.concat(F.lit("markers out of range "), F.array_join(bad.cast("array<string>"), ",")))).otherwise(F.array().cast("array<string>")),
        F.transform("bad_quotes", lambda r: F.concat(F.lit("unsupported quote of "), r)),
        F.when(F.col("question").rlike(T.RATIONALE) & ~F.col("abstained") & (F.col("n_quotes") == 0), F.array(F.lit("reason without quote"))).otherwise(F.array().cast("array<string>")),
    )
    return answers.withColumn("problems", parts)


def evidence_within(ledger: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Newest pieces of each session's ledger (session, seq, text) whose lengths sum up to the budget."""
    newest = Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("used", F.sum(F.length("text")).over(newest)).where(F.col("used") <= budget)


def merged_evidence(ledger: DataFrame) -> DataFrame:
    """(session, ref, text) of a ledger (session, seq, ref, is_code, text): one text for each reference.

    Code keeps its first text. History grows: a text that holds the old one replaces it, another one
    is added after dots. A fold over one reference's own entries, in order.
    """
    rows = ledger.groupBy("session", "ref", "is_code").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    fold = F.aggregate("xs", F.lit("").cast("string"), lambda a, x: F.when(a == "", x["text"]).when(F.col("is_code"), a).when(F.contains(x["text"], a), x["text"]).when(F.contains(a, x["text"]), a).otherwise(F.concat(a, F.lit("\n...\n"), x["text"])))
    return rows.select("session", "ref", fold.alias("text"))


def links_by_kind(numbers: DataFrame, known: DataFrame) -> DataFrame:
    """numbers (id, number) with the first known reference of PR#n, issue#n, discussion#n; others drop."""
    kinds = F.posexplode(F.array(F.lit("PR#"), F.lit("issue#"), F.lit("discussion#")))
    asked = numbers.select("id", "number", kinds.alias("pos", "prefix")).withColumn("ref", F.concat("prefix", "number"))
    return asked.join(known.select("ref").distinct(), "ref").groupBy("id", "number").agg(F.min(F.struct("pos", "ref")).alias("b")).select("id", "number", F.col("b.ref").alias("ref"))
