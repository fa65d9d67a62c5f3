"""Grounding and store queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import grounding as G
from lodestar.operators import store as S
from lodestar.plans.registry import Registry
from lodestar.plans.text_queries import QUOTE_SQL
from lodestar.session import table

R = Registry()
#: Evidence: a line range, a thread or a commit for each document, in sessions of its source.
EV_SQL = "ev AS (SELECT source AS session, doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN concat('m', doc_id % 4, '.py:', doc_id % 90 + 1, '-', doc_id % 90 + 30) WHEN 1 THEN concat('PR#', doc_id) ELSE concat('commit:', substr(md5(CAST(doc_id AS VARCHAR)), 1, 10)) END AS ref, CASE WHEN doc_id % 3 = 0 THEN concat('m', doc_id % 4, '.py') END AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 + 1 END AS s, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 + 30 END AS e, text FROM documents)"
CITE_SQL = "cites AS (SELECT source AS session, doc_id AS cite_id, CASE doc_id % 5 WHEN 0 THEN concat('`m', doc_id % 4, '.py#L', doc_id % 90 + 3, '-L', doc_id % 90 + 9, '`') WHEN 1 THEN concat('pr#', doc_id) WHEN 2 THEN concat('commit:', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) WHEN 3 THEN concat('m', doc_id % 4, '.py:', doc_id % 90 + 5) ELSE concat('issue#', doc_id) END AS ref FROM documents)"
RES_SQL = f"""{EV_SQL}, {CITE_SQL}, want AS (SELECT *, CASE WHEN instr(ref, '#L') > 0 THEN replace(concat(substr(trim(ref, '`'), 1, instr(trim(ref, '`'), '#L') - 1), ':', substr(trim(ref, '`'), instr(trim(ref, '`'), '#L') + 2)), '-L', '-') ELSE ref END AS w FROM cites),
rng AS (SELECT *, regexp_extract(w, '^(.+?):(\\d+)(?:-(\\d+))?$', 1) AS p, TRY_CAST(regexp_extract(w, '^(.+?):(\\d+)(?:-(\\d+))?$', 2) AS BIGINT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(w, '^(.+?):(\\d+)(?:-(\\d+))?$', 3), '') AS BIGINT), TRY_CAST(regexp_extract(w, '^(.+?):(\\d+)(?:-(\\d+))?$', 2) AS BIGINT)) AS b FROM want),
hits AS (SELECT session, cite_id, 1 AS way, seq, ev.ref AS resolved FROM want JOIN ev USING (session) WHERE lower(w) = lower(ev.ref)
 UNION ALL SELECT session, cite_id, 2, seq, ev.ref FROM want JOIN ev USING (session) WHERE w LIKE 'commit:%' AND ev.ref LIKE 'commit:%' AND length(w) >= 14 AND (starts_with(ev.ref, w) OR starts_with(w, ev.ref))
 UNION ALL SELECT session, cite_id, 3, seq, concat(p, ':', a, '-', b) FROM rng JOIN ev USING (session) WHERE ev.path = p AND s <= a AND a <= b AND b <= e),
res AS (SELECT session, cite_id, min(struct_pack(way := way, seq := seq, resolved := resolved)) AS h FROM hits GROUP BY ALL)"""


def evidence(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("m"), k % 4, F.lit(".py"))
    ref = F.when(k % 3 == 0, F.concat(path, F.lit(":"), k % 90 + 1, F.lit("-"), k % 90 + 30)).when(k % 3 == 1, F.concat(F.lit("PR#"), k)).otherwise(F.concat(F.lit("commit:"), F.substring(F.md5(k.cast("string")), 1, 10)))
    code = k % 3 == 0
    return table(spark, d, "documents").select(F.col("source").alias("session"), k.alias("seq"), ref.alias("ref"), F.when(code, path).alias("path"), F.when(code, k % 90 + 1).alias("start_line"), F.when(code, k % 90 + 30).alias("end_line"), "text")


def citations(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("m"), k % 4, F.lit(".py"))
    ref = F.when(k % 5 == 0, F.concat(F.lit("`"), path, F.lit("#L"), k % 90 + 3, F.lit("-L"), k % 90 + 9, F.lit("`"))).when(k % 5 == 1, F.concat(F.lit("pr#"), k)).when(k % 5 == 2, F.concat(F.lit("commit:"), F.substring(F.md5(k.cast("string")), 1, 8))).when(k % 5 == 3, F.concat(path, F.lit(":"), k % 90 + 5)).otherwise(F.concat(F.lit("issue#"), k))
    return table(spark, d, "documents").select(F.col("source").alias("session"), k.alias("cite_id"), ref.alias("ref"), "text")


@R.query(f"WITH {RES_SQL} SELECT cites.session, cites.cite_id, cites.ref, h.resolved AS resolved, h.seq AS seq, h.way AS way FROM cites LEFT JOIN res USING (session, cite_id)")
def citation_resolution(spark, d):
    return G.resolve(citations(spark, d).drop("text"), evidence(spark, d))


_QUOTE = "concat('  **', substr(text, 11, CASE WHEN doc_id % 4 = 0 THEN 12 ELSE 40 END), CASE WHEN doc_id % 7 = 3 THEN ' never' ELSE '' END, '  ** ')"


@R.query(f"""WITH {EV_SQL}, f AS (SELECT session, ref, min(seq) AS seq FROM ev GROUP BY ALL),
n AS (SELECT q.doc_id AS doc_id, {QUOTE_SQL.replace("{x}", "quote")} AS needle, {QUOTE_SQL.replace("{x}", "h.text")} AS hay FROM (SELECT doc_id, {_QUOTE} AS quote FROM documents) q JOIN ev ON ev.seq = doc_id JOIN f USING (session, ref) JOIN documents h ON h.doc_id = f.seq)
SELECT doc_id AS cite_id, length(needle) >= 20 AND contains(hay, needle) AS supported FROM n""")
def quote_containment(spark, d):
    k = F.col("seq")
    cut = F.when(k % 4 == 0, F.substring("text", 11, 12)).otherwise(F.substring("text", 11, 40))
    quote = F.concat(F.lit("  **"), cut, F.when(k % 7 == 3, " never").otherwise(""), F.lit("  ** "))
    quotes = evidence(spark, d).select("session", k.alias("cite_id"), "ref", quote.alias("quote"))  # each with the reference of its own row
    return G.quote_checks(quotes, evidence(spark, d)).select("cite_id", "supported")


@R.query("SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 4 = 1 THEN [concat('unresolved citation PR#', doc_id)] ELSE [] END, CASE WHEN doc_id % 6 <> 5 AND doc_id % 3 = 0 THEN ['no citation'] ELSE [] END, CASE WHEN doc_id % 3 = 0 THEN ['markers out of range 1'] WHEN doc_id % 3 = 1 THEN ['markers out of range 3'] ELSE [] END, CASE WHEN doc_id % 5 = 2 THEN [concat('unsupported quote of PR#', doc_id)] ELSE [] END, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 5 AND doc_id % 7 = 0 THEN ['reason without quote'] ELSE [] END), '; ') AS problems FROM documents")
def answer_validation(spark, d):
    k = F.col("doc_id")
    empty = F.array().cast("array<string>")
    pr = F.concat(F.lit("PR#"), k)
    rows = table(spark, d, "documents").select(
        k, F.when(k % 2 == 0, "Why so?").otherwise("How so?").alias("question"), F.when(k % 3 == 0, "So [1].").when(k % 3 == 1, "So [1] and [3].").otherwise("So.").alias("answer"),
        F.when(k % 3 == 0, empty).otherwise(F.array(pr)).alias("citations"), F.when(k % 4 == 1, F.array(pr)).otherwise(empty).alias("unresolved"), (k % 6 == 5).alias("abstained"), F.when(k % 7 == 0, 0).otherwise(1).alias("n_quotes"), F.when(k % 5 == 2, F.array(pr)).otherwise(empty).alias("bad_quotes"),
    )
    return G.answer_problems(rows).select("doc_id", F.array_join("problems", "; ").alias("problems"))


@R.query("SELECT source AS session, doc_id AS seq, used FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 40000")
def evidence_budget_pack(spark, d):
    ledger = table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), "text")
    return G.evidence_within(ledger).select("session", "seq", "used")


@R.query()
def evidence_merge(spark, d):
    """Ledger entries of one reference merged in order; the tests hold it against a loop."""
    k = F.col("turn")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat(F.lit("ref"), k % 3).alias("ref"), (k % 3 == 0).alias("is_code"), "text")
    return G.merged_evidence(turns)


@R.query("WITH known AS (SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'PR#' WHEN 1 THEN 'issue#' ELSE 'discussion#' END, doc_id % 400) AS ref FROM documents), n AS (SELECT doc_id AS id, doc_id * 3 % 500 AS number FROM documents), h AS (SELECT id, number, pos, ref FROM (SELECT id, number, unnest([0, 1, 2]) AS pos, concat(unnest(['PR#', 'issue#', 'discussion#']), number) AS ref FROM n) JOIN (SELECT DISTINCT ref FROM known) USING (ref)) SELECT id, number, min_by(ref, pos) AS ref FROM h GROUP BY id, number")
def thread_links_by_kind(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    known = docs.select(F.concat(F.when(k % 3 == 0, "PR#").when(k % 3 == 1, "issue#").otherwise("discussion#"), k % 400).alias("ref"))
    return G.links_by_kind(docs.select(k.alias("id"), (k * 3 % 500).alias("number")), known)


@R.query("WITH known AS (SELECT concat('release:v', doc_id, '.0.1') AS ref, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT concat('release:', doc_id, '.2.0'), doc_id FROM documents WHERE doc_id % 4 = 1) SELECT doc_id, ref FROM known WHERE doc_id % 4 IN (0, 1)")
def release_alias_lookup(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    known = docs.where(k % 2 == 0).select(F.concat(F.lit("release:v"), k, F.lit(".0.1")).alias("ref")).union(docs.where(k % 4 == 1).select(F.concat(F.lit("release:"), k, F.lit(".2.0"))))
    asked = docs.where((k % 4).isin(0, 1)).select("doc_id", F.when(k % 4 == 0, F.concat(F.lit("v"), k, F.lit(".0.1"))).otherwise(F.concat(k, F.lit(".2.0"))).alias("loose"))
    tried = asked.select("doc_id", F.posexplode(T.release_candidates(F.col("loose"))).alias("pos", "ref"))
    return tried.join(known.distinct(), "ref").groupBy("doc_id").agg(F.min_by("ref", "pos").alias("ref"))


@R.query("SELECT a.doc_id, b.doc_id AS commit_id FROM documents a JOIN documents b ON substr(md5(CAST(b.doc_id AS VARCHAR)), 1, 10) LIKE concat(substr(md5(CAST(a.doc_id AS VARCHAR)), 1, 7), '%')")
def sha_prefix_match(spark, d):
    sha = F.md5(F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents")
    full = docs.select(F.col("doc_id").alias("commit_id"), F.substring(sha, 1, 10).alias("sha")).withColumn("head", F.substring("sha", 1, G.MIN_SHA))
    short = docs.select("doc_id", F.substring(sha, 1, 7).alias("needle")).withColumn("head", F.substring("needle", 1, G.MIN_SHA))
    return short.join(full, "head").where(F.col("sha").startswith(F.col("needle"))).select("doc_id", "commit_id")


# ---- store ----------------------------------------------------------------------------------------
@R.query("SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 10 + l_linenumber) = 1")
def first_wins_dedupe(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return S.first_wins(rows, ["l_suppkey", "l_shipdate"], "seq").drop("seq")


@R.query("SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1")
def last_wins_upsert(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return S.last_wins(rows, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@R.query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ready' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("ready").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, -1.0).alias("c_acctbal"))
    return S.partial_update(rows, changes, "c_custkey")


@R.query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)")
def anti_join_todo(spark, d):
    done = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    todo = S.missing(table(spark, d, "lineitem"), done, ["l_partkey"])
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(todo, "l_partkey", "left_semi")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def semi_join_tracked(spark, d):
    held = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.cached(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), held, ["l_orderkey"])


@R.query("SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS hits, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS misses FROM customer GROUP BY c_mktsegment")
def cache_hits_misses(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    wanted = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    hits = S.cached(wanted, keys, ["c_custkey"]).withColumn("hit", F.lit(1))
    gone = wanted.join(keys, "c_custkey", "left_anti").withColumn("hit", F.lit(0))
    return hits.unionByName(gone).groupBy("c_mktsegment").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


@R.query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'failed' ELSE 'ready' END AS status FROM orders")
def startup_recovery(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "ingesting").otherwise("ready")
    return S.recovered(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


@R.query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, json_extract(props, '$.k') ORDER BY event_id) = 1")
def repeat_call_suppression(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("args"), "event_id")
    return S.first_wins(rows, ["user_id", "event_type", "args"], "event_id").drop("args")


@R.query("SELECT doc_id, line, change FROM (SELECT doc_id, line, kind, max(CASE WHEN kind = 'change' THEN struct_pack(l := line, t := text) END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING).t AS change FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text, CASE WHEN (generate_subscripts(string_split(text, chr(10)), 1) * 7 + doc_id) % 5 = 0 THEN 'why' WHEN (generate_subscripts(string_split(text, chr(10)), 1) * 7 + doc_id) % 5 = 2 THEN 'change' END AS kind FROM documents)) WHERE kind = 'why'")
def why_line_lookback(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    k = (F.col("line") * 7 + F.col("doc_id")) % 5
    back = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-5, -1)
    change = F.last(F.when(k == 2, F.col("text")), ignorenulls=True).over(back)
    return rows.select("doc_id", "line", change.alias("change"), k.alias("k")).where("k = 0").drop("k")


@R.query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_tumbling(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@R.query("SELECT date_trunc('hour', ts) - to_hours(k) AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL")
def event_windows_sliding(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@R.query("WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def event_windows_session(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")
