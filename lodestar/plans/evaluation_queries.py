"""Evaluation queries over labels, events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import evaluation as E
from lodestar.plans.registry import Registry
from lodestar.session import table

R = Registry()


@R.query("SELECT event_type, xs[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50, xs[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS xs, count(*) AS n FROM events GROUP BY event_type)")
def percentile_half_even(spark, d):
    counts = E.value_counts(table(spark, d, "events"), ["event_type"], "value")
    return E.percentiles(counts, ["event_type"], "value", {"p50": (0.5, E.HALF_EVEN), "p95": (0.95, E.HALF_EVEN)})


@R.query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def latency_p95_linear(spark, d):
    counts = E.value_counts(table(spark, d, "events"), ["event_type"], "value")
    found = E.percentiles(counts, ["event_type"], "value", {"low": (0.5, E.DOWN), "high": (0.5, E.UP), "p95": (0.95, E.DOWN)})
    return found.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95")


_BOOT = """SELECT round(avg(x), 6) AS mean, (SELECT round(quantile_cont(m, 0.025), 6) FROM means) AS low, (SELECT round(quantile_cont(m, 0.975), 6) FROM means) AS high, count(x) AS n FROM v"""
_MEANS = "means AS (SELECT r, avg(x) AS m FROM (SELECT r, k, ((r * 1103515245 + k * 2654435761 + 86415) % 2147483647 * 48271 % 2147483647) % (SELECT count(*) FROM v) AS j FROM range(5000) a(r), range((SELECT count(*) FROM v)) b(k)) JOIN v ON v.i = j GROUP BY r)"


def _few(df):
    """Questions of an evaluation: the items of the benchmark carry them."""
    return df.withColumn("i", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint"))


def _ci(df):
    out = E.bootstrap_ci(df)
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@R.query(f"WITH v AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, CAST(length(text) % 7 AS DOUBLE) / 6 AS x FROM benchmark), {_MEANS} {_BOOT}")
def bootstrap_ci(spark, d):
    return _ci(_few(table(spark, d, "benchmark")).select("i", ((F.length("text") % 7).cast("double") / 6).alias("value")))


@R.query(f"WITH v AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, CAST(length(text) % 7 AS DOUBLE) / 6 - CAST(length(text) % 5 AS DOUBLE) / 8 AS x FROM benchmark), {_MEANS} {_BOOT}")
def paired_diff(spark, d):
    value = (F.length("text") % 7).cast("double") / 6 - (F.length("text") % 5).cast("double") / 8
    return _ci(_few(table(spark, d, "benchmark")).select("i", value.alias("value")))


@R.query("""WITH c AS (SELECT count(*) FILTER (WHERE length(text) % 7 >= 3 AND NOT length(text) % 5 >= 2) AS a_only, count(*) FILTER (WHERE NOT length(text) % 7 >= 3 AND length(text) % 5 >= 2) AS b_only FROM benchmark)
SELECT a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least(a_only, b_only) + 1), lambda k: exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) - (a_only + b_only) * ln(2.0))))), 6) END AS p_value FROM c""")
def mcnemar_exact(spark, d):
    pairs = table(spark, d, "benchmark").select((F.length("text") % 7 >= 3).alias("a"), (F.length("text") % 5 >= 2).alias("b"))
    return E.mcnemar(pairs).withColumn("p_value", F.round("p_value", 6))


@R.query("WITH s AS (SELECT avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END) AS po, avg(CAST(quality AS DOUBLE)) AS pa, avg(1.0 - toxic) AS pb FROM labels) SELECT round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM s")
def cohens_kappa(spark, d):
    pairs = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return E.kappa(pairs).select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


_RANK = "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id * 7 % 13 + 1 END"


@R.query(f"SELECT lang, source, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_10 FROM (SELECT *, {_RANK} AS rank FROM documents) GROUP BY lang, source")
def recall_mrr(spark, d):
    return E.recall_mrr(table(spark, d, "documents").select("lang", "source", F.expr(_RANK).alias("rank")), ["lang", "source"])


_REC = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'agent' ELSE 'baseline' END AS system, o_orderpriority AS category, o_orderkey % 5 <> 0 AS answerable, o_orderkey % 7 = 0 AS declined, o_orderkey % 11 <> 0 AS judged, o_orderkey % 13 = 0 AS contradicts, o_orderkey % 4 AS covered, o_custkey % 4 + 3 AS facts, o_totalprice AS latency, o_custkey AS tokens, o_orderkey % 17 = 0 AS error FROM orders"
_SCORE = "CASE WHEN answerable THEN CASE WHEN declined OR NOT judged OR contradicts OR facts = 0 THEN 0.0 ELSE CAST(covered AS DOUBLE) / facts END ELSE CASE WHEN declined THEN 1.0 ELSE 0.0 END END"


def _records(spark, d):
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(F.when(cust % 2 == 0, "agent").otherwise("baseline").alias("system"), F.col("o_orderpriority").alias("category"), (key % 5 != 0).alias("answerable"), (key % 7 == 0).alias("declined"), (key % 11 != 0).alias("judged"), (key % 13 == 0).alias("contradicts"), (key % 4).alias("covered"), (cust % 4 + 3).alias("facts"), F.col("o_totalprice").alias("latency"), cust.alias("tokens"), (key % 17 == 0).alias("error"))
    return rows.withColumn("correct", E.question_score(*[F.col(c) for c in ("answerable", "declined", "judged", "contradicts", "covered", "facts")]))


@R.query(f"SELECT system, category, answerable, round(avg({_SCORE}), 6) AS score, count(*) AS n FROM ({_REC}) GROUP BY ALL")
def question_scores(spark, d):
    return _records(spark, d).groupBy("system", "category", "answerable").agg(F.round(F.avg("correct"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@R.query(f"""WITH r AS (SELECT *, {_SCORE} AS correct FROM ({_REC})), g AS (SELECT system, CASE WHEN GROUPING(category) = 1 THEN '*' ELSE category END AS category, count(*) AS n, round(avg(correct), 6) AS correctness, round(avg(correct) FILTER (WHERE answerable), 6) AS correctness_answerable,
 round(avg(CAST(declined AS DOUBLE)) FILTER (WHERE NOT answerable), 6) AS correct_declines, round(avg(CAST(declined AS DOUBLE)) FILTER (WHERE answerable), 6) AS false_declines, list_sort(list(latency)) AS xs, round(avg(tokens), 6) AS tokens, count(*) FILTER (WHERE error) AS errors FROM r GROUP BY GROUPING SETS ((system, category), (system)))
SELECT system, category, n, correctness, correctness_answerable, correct_declines, false_declines, xs[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS latency_p50, xs[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS latency_p95, tokens, errors FROM g""")
def system_category_report(spark, d):
    return E.system_report(_records(spark, d))


@R.query("SELECT o_orderkey AS id, o_orderpriority AS repo, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders")
def round_robin(spark, d):
    return E.round_robin(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("repo")))


@R.query("SELECT DISTINCT a.l_orderkey AS id FROM lineitem a WHERE a.l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'")
def set_intersect_ids(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).intersect(rows.where("l_linestatus = 'O' and l_returnflag = 'N'").select("l_orderkey"))


@R.query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT p_partkey FROM part WHERE p_size > 10")
def set_except_links(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")).exceptAll(table(spark, d, "part").where("p_size > 10").select("p_partkey"))


@R.query("SELECT user_id, event_type, count(*) AS requests, round(sum(value), 4) AS tokens, count(DISTINCT json_extract(props, '$.k')) AS tools FROM events GROUP BY user_id, event_type")
def usage_sums(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("tokens"), F.countDistinct(F.get_json_object("props", "$.k")).alias("tools"))


@R.query("SELECT source, lang, doc_id, density FROM (SELECT source, lang, doc_id, round(len(regexp_extract_all(text, '(?i) (the|der|la) ')) / greatest(1.0, length(text) / 1000.0), 6) AS density FROM documents) WHERE density > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY density DESC, doc_id) <= 40")
def causal_density_topk(spark, d):
    """Density of marker words; the corpus has no causal phrases, so its commonest words stand for them."""
    density = F.round(F.regexp_count("text", F.lit("(?i) (the|der|la) ")) / F.greatest(F.lit(1.0), F.length("text") / 1000.0), 6)
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", density.alias("density")).where("density > 0")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("density"), "doc_id"))
    return rows.withColumn("n", n).where("n <= 40").drop("n")


@R.query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def kind_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


# ---- audit of a judge by a second one -------------------------------------------------------------
#: Labelled documents are answers; up to four facts each, verdicts by their numbers; every fifth reply cannot be read.
RECORDS_SQL = """records AS (SELECT doc_id AS id, concat('system', doc_id % 3) AS system, list_transform(range(doc_id % 5), lambda i: {'fact': concat('fact ', doc_id, '.', i), 'covered': (doc_id * 7 + i * 3) % 4 > 0}) AS key_facts, quality = 1 AS answerable, doc_id % 8 = 3 AS declined, doc_id % 13 > 0 AS judged, toxic = 1 AS contradicts FROM labels),
replies AS (SELECT id, system, list_transform(range(len(key_facts)), lambda i: (id * 7 + i * 3) % 4 > 0 AND (id + i) % 6 > 0) AS second FROM records WHERE len(key_facts) > 0 AND id % 5 > 0),
decisions AS (SELECT id, system, unnest(range(len(second))) AS i, unnest(list_transform(key_facts, lambda f: f.fact)) AS fact, unnest(list_transform(key_facts, lambda f: f.covered)) AS judge, unnest(second) AS second FROM records JOIN replies USING (id, system))"""


def _judged(spark, d):
    """(records, decisions) of both judges."""
    k = F.col("doc_id")
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), lambda i: i < k % 5)
    first = lambda i: (k * 7 + i * 3) % 4 > 0
    facts = F.transform(places, lambda i: F.struct(F.concat(F.lit("fact "), k, F.lit("."), i).alias("fact"), first(i).alias("covered")))
    reply = F.array_join(F.transform(places, lambda i: F.when(first(i) & ((k + i) % 6 > 0), "Yes").otherwise("no")), "\n")
    rows = table(spark, d, "labels").select(
        k.alias("id"), F.concat(F.lit("system"), k % 3).alias("system"), facts.alias("key_facts"), (F.col("quality") == 1).alias("answerable"), (k % 8 == 3).alias("declined"), (k % 13 > 0).alias("judged"),
        (F.col("toxic") == 1).alias("contradicts"), F.when(k % 5 > 0, reply).otherwise("I cannot tell").alias("reply"),
    )
    records = rows.drop("reply")
    return records, E.judge_decisions(records, rows.select("id", "system", "reply"))


@R.query(f"""WITH {RECORDS_SQL}, p AS (SELECT avg(CASE WHEN judge = second THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN judge THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN second THEN 1.0 ELSE 0.0 END) AS pb, count(*) AS n, count(*) FILTER (WHERE judge <> second) AS k FROM decisions)
SELECT (SELECT count(*) FROM replies) AS answers, (SELECT count(*) FROM records WHERE len(key_facts) > 0 AND id % 5 = 0) AS unparsed, n AS decisions, k AS disagreements, round(pa, 6) AS judge_rate, round(pb, 6) AS second_rate, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM p""")
def judge_audit(spark, d):
    return E.judge_audit(*_judged(spark, d)).select("answers", "unparsed", "decisions", "disagreements", *[F.round(c, 6).alias(c) for c in ("judge_rate", "second_rate", "agreement", "kappa")])


@R.query(f"WITH {RECORDS_SQL} SELECT id, system, fact, judge, second FROM decisions WHERE judge <> second")
def judge_disagreements(spark, d):
    _, decisions = _judged(spark, d)
    return decisions.where("judge <> second").select("id", "system", "fact", "judge", "second")


@R.query(f"""WITH {RECORDS_SQL}, c AS (SELECT r.*, len(key_facts) AS facts, len(list_filter(key_facts, lambda f: f.covered)) AS first, coalesce(len(list_filter(s.second, lambda x: x)), len(list_filter(key_facts, lambda f: f.covered))) AS again FROM records r LEFT JOIN replies s USING (id, system)),
v AS (SELECT system, CASE WHEN NOT answerable THEN CAST(declined AS DOUBLE) WHEN declined OR NOT judged OR contradicts OR facts = 0 THEN 0.0 ELSE first / facts END AS x, CASE WHEN NOT answerable THEN CAST(declined AS DOUBLE) WHEN declined OR NOT judged OR contradicts OR facts = 0 THEN 0.0 ELSE again / facts END AS y FROM c)
SELECT system, count(*) AS n, round(avg(x), 6) AS judge, round(avg(y), 6) AS second FROM v GROUP BY system""")
def judged_correctness(spark, d):
    return E.judged_correctness(*_judged(spark, d)).select("system", "n", F.round("judge", 6).alias("judge"), F.round("second", 6).alias("second"))
