"""Evaluation statistics: means, percentiles, bootstrap intervals, McNemar, kappa, recall, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.ranges import BLOCK

#: Resamples of a bootstrap, seed of the draws, share of facts that solves a question.
RESAMPLES, SEED, SOLVED = 5000, 7, 0.5


#: How the place q * (n - 1) of an element is rounded.
HALF_EVEN: Callable[[Column], Column] = lambda x: F.bround(x, 0).cast("bigint")
DOWN: Callable[[Column], Column] = lambda x: F.floor(x).cast("bigint")
UP: Callable[[Column], Column] = lambda x: F.ceil(x).cast("bigint")


def percentiles(counts: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """For each group, elements of its sorted values by place: by, and a column for each wanted (q, rounding).

    counts: by, value, m (how often the value occurs). Equal values are counted before the shuffle
    and a running sum finds the places, so no group's values are gathered in one cell. Nulls are left
    out; a group of nulls alone has no row.
    """
    own = counts.where(F.col(value).isNotNull())
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy(value))
    rows = own.withColumns({"upto": upto, "n": F.sum("m").over(Window.partitionBy(*by))})
    place = lambda q, rounded: rounded(F.lit(q) * (F.col("n") - 1))
    here = lambda q, rounded: (F.col("upto") > place(q, rounded)) & (F.col("upto") - F.col("m") <= place(q, rounded))
    return rows.groupBy(*by).agg(*[F.max(F.when(here(*w), F.col(value))).alias(name) for name, w in wanted.items()])


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, m): how often each value occurs in each group."""
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))


def draw(resample: Column, place: Column, n: Column) -> Column:
    """Index below n for a place of a resample: a linear congruential step, the same in any engine."""
    return F.pmod((resample * 1_103_515_245 + place * 2_654_435_761 + SEED * 12_345) % 2_147_483_647 * 48_271 % 2_147_483_647, n)


def bootstrap_ci(values: DataFrame, alpha: float = 0.05, resamples: int = RESAMPLES) -> DataFrame:
    """(mean, low, high, n) of values (i from 0 without gaps, value): percentile bootstrap of the mean.

    Each resample draws as many values as there are. Values of an evaluation are few (questions),
    so they are one array; the resamples are spread over the tasks. Without values all is null but n.
    """
    spark = values.sparkSession
    held = values.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("xs"), F.avg("value").alias("mean"), F.count("value").alias("n"))
    means = spark.range(resamples).select(F.col("id").alias("r")).crossJoin(F.broadcast(held)).where("n > 0")  # one row of values
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), F.lit(0.0), lambda a, k: a + F.element_at("xs", (draw(F.col("r"), k, F.col("n")) + 1).cast("int")))
    spread = means.select((total / F.col("n")).alias("m")).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return held.select("mean", "n").crossJoin(spread)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(a_only, b_only, p_value) of pairs (a, b): exact two-sided McNemar test on discordant pairs."""
    counts = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    n, least = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # Terms C(n, k) / 2**n by their logarithms, each from the one before, so that many pairs do not overflow.
    first = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))
    step = lambda a, k: F.struct((a["term"] + F.log((n - k + 1) / k)).alias("term"), (a["total"] + F.exp(a["term"] + F.log((n - k + 1) / k))).alias("total"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("bigint"), least), lambda k: k > 0), first, step)["total"]
    return counts.select("a_only", "b_only", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def kappa(pairs: DataFrame) -> DataFrame:
    """(agreement, kappa) of pairs (a, b) of booleans; kappa is 1 where chance agreement is 1."""
    stats = pairs.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return stats.select(F.col("po").alias("agreement"), F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def first_relevant(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, by, rank): the best rank of a relevant hit in each list of each question with gold; null if there is none.

    hits: query_id, by (what tells a question's lists apart), rank, is_history, ref, path, start, end; gold:
    query_id, is_history, ref, path, start, end, whole. A hit of code or documents is relevant if it
    overlaps a gold range of its path, or its path is gold as a whole; one of history if its reference is
    gold, in any case. Ranges meet by blocks of lines; every list of a question with gold has a row.
    """
    code, history = hits.where(~F.col("is_history")), hits.where("is_history")
    spread = lambda rows: rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))
    ranges = spread(gold.where("not is_history and not whole").select("query_id", "path", "start", "end")).withColumnsRenamed({"start": "s", "end": "e"})
    overlaps = spread(code.select("query_id", *by, "rank", "path", "start", "end")).join(ranges, ["query_id", "path", "block"]).where("s <= end and start <= e")
    files = code.join(gold.where("not is_history and whole").select("query_id", "path").distinct(), ["query_id", "path"])
    low = F.lower(T.normal_ref(F.col("ref"))).alias("low")
    refs = history.withColumn("low", low).join(gold.where("is_history").select("query_id", low).distinct(), ["query_id", "low"])
    found = overlaps.select("query_id", *by, "rank").unionByName(files.select("query_id", *by, "rank")).unionByName(refs.select("query_id", *by, "rank"))
    lists = hits.join(gold.select("query_id").distinct(), "query_id", "left_semi").select("query_id", *by).distinct()
    return lists.join(found.groupBy("query_id", *by).agg(F.min("rank").alias("rank")), ["query_id", *by], "left")


def judge_decisions(records: DataFrame, replies: DataFrame) -> DataFrame:
    """(id, system, i, fact, judge, second): both judges' verdicts on each fact, matched by place.

    records: id, system, key_facts array<struct<fact,covered>>; replies: id, system, reply, the second
    judge's text. Records without facts, without a reply, or whose reply has not as many verdicts as
    there are facts are left out.
    """
    both = records.where(F.size("key_facts") > 0).join(replies, ["id", "system"]).withColumn("second", T.verdicts(F.col("reply"), F.size("key_facts")))
    facts = both.where("second is not null").select("id", "system", F.posexplode(F.arrays_zip("key_facts", "second")).alias("i", "z"))
    return facts.select("id", "system", "i", F.col("z.key_facts.fact").alias("fact"), F.col("z.key_facts.covered").alias("judge"), F.col("z.second").alias("second"))


def judge_audit(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: answers, unparsed, decisions, disagreements, agreement, kappa, judge_rate, second_rate; rates are null without decisions."""
    pairs = decisions.select(F.col("judge").alias("a"), F.col("second").alias("b"))
    rates = pairs.agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("a") != F.col("b")).alias("disagreements"), F.avg(F.col("a").cast("double")).alias("judge_rate"), F.avg(F.col("b").cast("double")).alias("second_rate"))
    counts = records.where(F.size("key_facts") > 0).select("id", "system").join(decisions.select("id", "system").distinct().withColumn("parsed", F.lit(True)), ["id", "system"], "left").agg(F.count("parsed").alias("answers"), F.count_if(F.col("parsed").isNull()).alias("unparsed"))
    return counts.crossJoin(rates).crossJoin(kappa(pairs))  # one row each


def judged_correctness(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """(system, n, judge, second): mean correctness of each system under either judge.

    records: id, system, key_facts, answerable, declined, judged, contradicts. Under the second judge a
    record has its verdicts; one that it did not judge keeps the first judge's.
    """
    again = decisions.groupBy("id", "system").agg(F.count_if("second").alias("again"))
    covered = F.size(F.filter(F.coalesce("key_facts", F.array().cast(records.schema["key_facts"].dataType)), lambda f: f["covered"]))
    rows = records.withColumn("covered", covered).withColumn("facts", F.coalesce(F.size("key_facts"), F.lit(0))).join(again, ["id", "system"], "left")
    score = lambda c: question_score(F.col("answerable"), F.col("declined"), F.col("judged"), F.col("contradicts"), c, F.col("facts"))
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.avg(score(F.col("covered"))).alias("judge"), F.avg(score(F.coalesce("again", "covered"))).alias("second"))


def recall_mrr(ranks: DataFrame, by: list[str]) -> DataFrame:
    """recall at 1, 5, 10 and MRR at 10 of rows with rank (null: not found), by groups."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(hit(k), 6).alias(f"recall_{k}") for k in (1, 5, 10)], F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_10"))


def question_score(answerable: Column, declined: Column, judged: Column, contradicts: Column, covered: Column, facts: Column) -> Column:
    """1 for a right decline; for an answer the share of covered facts, 0 if declined, unjudged or contradicting."""
    answered = F.when(declined | ~judged | contradicts | (facts == 0), 0.0).otherwise(covered / facts)
    return F.when(answerable, answered).otherwise(declined.cast("double"))


def system_report(records: DataFrame) -> DataFrame:
    """Metrics of records (system, category, correct, answerable, declined, latency, tokens, error), overall and by category."""
    rows = records.rollup("system", "category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("correctness"), F.round(F.avg(F.when(F.col("answerable"), F.col("correct"))), 6).alias("correctness_answerable"),
        F.round(F.avg(F.when(~F.col("answerable"), F.col("declined").cast("double"))), 6).alias("correct_declines"), F.round(F.avg(F.when(F.col("answerable"), F.col("declined").cast("double"))), 6).alias("false_declines"),
        F.round(F.avg("tokens"), 6).alias("tokens"), F.count_if("error").alias("errors"),
        F.grouping("category").alias("overall"),
    )
    counts = value_counts(records, ["system", "category"], "latency")
    every = counts.groupBy("system", "latency").agg(F.sum("m").alias("m")).select("system", F.lit(None).cast("string").alias("category"), "latency", "m", F.lit(1).alias("overall"))
    latency = percentiles(counts.withColumn("overall", F.lit(0)).unionByName(every), ["system", "category", "overall"], "latency", {"latency_p50": (0.5, HALF_EVEN), "latency_p95": (0.95, HALF_EVEN)})
    latency = latency.withColumnsRenamed({"system": "_system", "category": "_category", "overall": "_overall"})
    same = F.col("system").eqNullSafe(F.col("_system")) & F.col("category").eqNullSafe(F.col("_category")) & (F.col("overall") == F.col("_overall"))
    report = rows.where("system is not null").join(latency, same, "left").drop("_system", "_category", "_overall")
    return report.withColumn("category", F.when(F.col("overall") == 1, "*").otherwise(F.col("category"))).drop("overall")


def round_robin(questions: DataFrame) -> DataFrame:
    """questions (id, repo) with their turn: one of each repo after the other."""
    turn = F.row_number().over(Window.partitionBy("repo").orderBy("id"))
    return questions.withColumn("turn", turn)
