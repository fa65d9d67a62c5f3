"""Retrieval queries: BM25, dense, fusion, history search, symbols, grep and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import inverted as I
from lodestar.operators import retrieval as X
from lodestar.plans.registry import Registry
from lodestar.plans.stored import rows_of, stored
from lodestar.plans.text_queries import tokens_sql
from lodestar.session import cut, table

R = Registry()
QUESTIONS = {1: "Why is the eding of thing then?", 2: "Where does retry der und die?", 3: "explain que dans the elle", 4: "ingly hand"}
KIND = "CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'doc' WHEN 'fr' THEN 'issue' ELSE 'pr' END"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: id, repo, kind, title, text."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), F.expr(KIND).alias("kind"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text")


def questions(spark: SparkSession, which: dict[int, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((which or QUESTIONS).items()), "query_id bigint, text string")


def _terms_sql(which: dict[int, str]) -> str:
    import re

    rows = []
    for k, q in which.items():
        for t in dict.fromkeys(x.lower() for x in re.findall(T.IDENTIFIER, q)):
            if t not in T.STOPWORDS and len(t) > 1:
                rows.append(f"({k}, '{t}')")
    return f"(VALUES {', '.join(rows)}) AS q(query_id, term)"


def bm25_sql(which: dict[int, str]) -> str:
    """CTEs that end in scored(query_id, id, score)."""
    return f"""toks AS (SELECT doc_id AS id, {tokens_sql("text")} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM {_terms_sql(which)}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, avgdl, CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
scored AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN w USING (term) JOIN {_terms_sql(which)} USING (term) GROUP BY query_id, id)"""


def index(spark, d) -> I.InvertedIndex:
    """The stored index of the documents' texts, with their kinds."""
    rows = chunks(spark, d).select("id", F.col("text").alias("body"), "kind")
    return I.InvertedIndex(stored(spark, d, "documents", "index", rows_of(I.build, rows)))


def terms(spark, which=None) -> DataFrame:
    return X.question_terms(questions(spark, which))


@R.query(f"WITH {bm25_sql({1: QUESTIONS[1]})} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10")
def bm25_topk(spark, d):
    return index(spark, d).top(terms(spark, {1: QUESTIONS[1]}), 10).select("id", "score", "rank")


@R.query(f"WITH {bm25_sql(QUESTIONS)} SELECT query_id, id, score FROM scored")
def bm25_scores_multi_query(spark, d):
    return index(spark, d).scores(terms(spark))


@R.query(f"WITH {bm25_sql({2: QUESTIONS[2]})} SELECT s.id, s.score, {KIND} AS kind FROM scored s JOIN documents ON doc_id = s.id WHERE lang IN ('de', 'fr') ORDER BY s.score DESC, s.id LIMIT 50")
def bm25_kind_filtered(spark, d):
    best = index(spark, d).top(terms(spark, {2: QUESTIONS[2]}), X.CANDIDATES, F.col("kind").isin("doc", "issue"))
    return best.join(chunks(spark, d).select("id", "kind"), "id").select("id", "score", "kind")


@R.query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def postings_statistics(spark, d):
    return index(spark, d).terms()


DOT_SQL = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark, d) -> DataFrame:
    """The stated query set of vector searches: every vector whose id is divisible by 20."""
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@R.query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT_SQL} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT_SQL} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10")
def dense_topk(spark, d):
    return X.dense_top(vectors(spark, d), asked(spark, d), 10)


@R.query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, {DOT_SQL} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT_SQL} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label IN (1, 3) QUALIFY rank <= 10")
def dense_topk_kind_filtered(spark, d):
    return X.dense_top(vectors(spark, d).where("label in (1, 3)"), asked(spark, d), 10)


@R.query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    x = F.transform("vector", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    v = vectors(spark, d).select("id", norm.alias("norm"), F.transform(x, lambda v: v / F.greatest(norm, F.lit(1e-12))).alias("unit"))
    return v.select("id", F.round("norm", 6).alias("norm"), F.round(F.element_at("unit", 1), 6).alias("first"))


@R.query("SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS n_queries, count(*) AS n_indexed, true AS nine_of_ten FROM embeddings")
def ann_recall_at_10(spark, d):
    """Whether the index of all vectors finds nine tenths of the exact ten nearest of every stated query."""
    from lodestar.operators import ivf

    held = stored(spark, d, "embeddings", "cells", rows_of(ivf.build, vectors(spark, d).select("id", "vector")))
    found = ivf.search(held, asked(spark, d), 10)
    exact = X.dense_top(vectors(spark, d), asked(spark, d), 10)
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = both.agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("nine_of_ten"))
    return recall.crossJoin(held.read("lists").agg(F.sum("n").alias("n_indexed")))


LISTS = f"WITH {bm25_sql(QUESTIONS)}, typed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50), lex AS (SELECT v.query_id, t.id, t.rank FROM typed t JOIN (SELECT vec_id // 20 + 1 AS query_id FROM embeddings WHERE vec_id % 20 = 0) v ON t.query_id = (v.query_id - 1) % 4 + 1), den AS (SELECT a.vec_id // 20 + 1 AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT_SQL} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 50)"
FUSED = "f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY query_id, id)"


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both lists of every stated vector: they take the typed questions in turn, so that each is asked."""
    ask = asked(spark, d).withColumn("query_id", (F.col("query_id") / 20 + 1).cast("bigint"))
    typed = cut(index(spark, d).top(terms(spark), X.CANDIDATES).select(F.col("query_id").alias("typed"), "id", "rank"))  # 50 rows for each typed question
    every = ask.select("query_id").union(questions(spark).select("query_id")).distinct().withColumn("typed", (F.col("query_id") - 1) % len(QUESTIONS) + 1)
    lexical = every.join(F.broadcast(typed), "typed").select("query_id", "id", "rank")
    dense = cut(X.dense_top(vectors(spark, d), ask, X.CANDIDATES).select("query_id", "id", "rank"))  # read more than once, searched once
    return lexical, dense


@R.query(f"{LISTS}, {FUSED} SELECT query_id, id, score FROM f")
def rrf_fusion(spark, d):
    lexical, dense = _lists(spark, d)
    return X.fuse(lexical.unionByName(dense)).withColumn("score", F.round("score", 6))


@R.query(f"{LISTS}, {FUSED} SELECT * FROM (SELECT f.query_id, f.id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, lex.rank NULLS LAST, den.rank NULLS LAST, f.id) AS rank, {KIND} AS kind, split_part(text, chr(10), 1) AS title FROM f JOIN documents ON doc_id = f.id LEFT JOIN lex USING (query_id, id) LEFT JOIN den USING (query_id, id)) WHERE rank <= 8")
def hybrid_search(spark, d):
    lexical, dense = _lists(spark, d)
    fused = X.fuse(lexical.unionByName(dense)).withColumn("score", F.round("score", 6))
    rows = fused.join(lexical.withColumnRenamed("rank", "lexical"), ["query_id", "id"], "left").join(dense.withColumnRenamed("rank", "semantic"), ["query_id", "id"], "left").join(chunks(spark, d).select("id", "kind", "title"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("lexical").asc_nulls_last(), F.col("semantic").asc_nulls_last(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("query_id", "id", "score", "rank", "kind", "title")


# ---- ranked lists against gold evidence ----------------------------------------------------------
#: The lists' best DEPTH; hits are line ranges of code and documents, or history by reference.
DEPTH = 20
SHOWN_SQL = f"SELECT doc_id, {KIND} AS kind, lang IN ('en', 'de') AS is_code, source AS path, doc_id * 13 % 700 + 1 AS s, doc_id * 13 % 700 + 1 + doc_id * 31 % 97 AS e FROM documents"
RANKS_SQL = f"""{LISTS}, {FUSED}, fused AS (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.id) AS rank FROM f),
hits AS (SELECT query_id, mode, rank, NOT is_code AS is_history, concat(kind, '#', doc_id) AS ref, path, s, e FROM (SELECT *, 'bm25' AS mode FROM lex UNION ALL SELECT *, 'dense' FROM den UNION ALL SELECT *, 'hybrid' FROM fused) JOIN ({SHOWN_SQL}) ON doc_id = id WHERE rank <= {DEPTH}),
gold AS (SELECT doc_id // 11 % 25 + 1 AS query_id, NOT is_code AS is_history, upper(concat(kind, '#', doc_id)) AS ref, path, doc_id * 29 % 600 + 1 AS gs, doc_id * 29 % 600 + 40 AS ge, doc_id % 9 = 0 AS whole FROM ({SHOWN_SQL}) WHERE doc_id % 11 = 0),
firsts AS (SELECT h.query_id, h.mode, min(h.rank) FILTER (WHERE g.query_id IS NOT NULL) AS rank FROM hits h LEFT JOIN gold g ON g.query_id = h.query_id AND g.is_history = h.is_history AND CASE WHEN h.is_history THEN lower(g.ref) = lower(h.ref) ELSE g.path = h.path AND (g.whole OR (g.gs <= h.e AND h.s <= g.ge)) END
  WHERE h.query_id IN (SELECT query_id FROM gold) GROUP BY h.query_id, h.mode)"""


def _shown(spark, d) -> DataFrame:
    k, kind = F.col("doc_id"), F.expr(KIND)
    return table(spark, d, "documents").select(k.alias("id"), (~F.col("lang").isin("en", "de")).alias("is_history"), F.concat(kind, F.lit("#"), k).alias("ref"), F.col("source").alias("path"), (k * 13 % 700 + 1).alias("start"), (k * 13 % 700 + 1 + k * 31 % 97).alias("end"))


def _first_ranks(spark, d) -> DataFrame:
    from lodestar.operators import evaluation as E

    lexical, dense = _lists(spark, d)
    fused = X.ranked(X.fuse(lexical.unionByName(dense)).withColumn("score", F.round("score", 6)), DEPTH).select("query_id", "id", "rank")
    modes = [rows.where(F.col("rank") <= DEPTH).withColumn("mode", F.lit(name)) for name, rows in (("bm25", lexical), ("dense", dense), ("hybrid", fused))]
    hits = modes[0].unionByName(modes[1]).unionByName(modes[2]).join(_shown(spark, d), "id")
    k = F.col("id")
    gold = _shown(spark, d).where(k % 11 == 0).select((F.floor(k / 11) % 25 + 1).alias("query_id"), "is_history", F.upper("ref").alias("ref"), "path", (k * 29 % 600 + 1).alias("start"), (k * 29 % 600 + 40).alias("end"), (k % 9 == 0).alias("whole"))
    return E.first_relevant(hits, gold, ["mode"])


@R.query(f"{RANKS_SQL} SELECT query_id, mode, rank FROM firsts")
def first_relevant_rank(spark, d):
    return _first_ranks(spark, d)


@R.query(f"{RANKS_SQL} SELECT mode, count(*) AS n, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}' for k in (1, 5, 10))}, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_10 FROM firsts GROUP BY mode")
def recall_of_lists(spark, d):
    """Recall and MRR of the real lists, by how they were made."""
    from lodestar.operators import evaluation as E

    return E.recall_mrr(_first_ranks(spark, d), ["mode"])


BODY_SQL = r"""SELECT doc_id, concat_ws(' ', title, symbol, path) AS head, text FROM (SELECT doc_id, nullif(split_part(text, chr(10), 1), '') AS title, CASE WHEN doc_id % 3 = 0 THEN concat('retryDelay', doc_id % 7, '.HTTPServer_getURL') END AS symbol, concat(source, '/docPage', doc_id, '.txt') AS path, text FROM documents)"""
_HUMPS_SQL = r"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"


@R.query(rf"""WITH b AS ({BODY_SQL}), i AS (SELECT doc_id, head, text, list_filter(regexp_extract_all(concat(head, ' ', text), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: regexp_matches(x, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]')) AS humps FROM b)
SELECT doc_id, md5(concat_ws(' ', head, text, array_to_string(list_transform(humps, lambda x: array_to_string(list_filter(string_split(lower({_HUMPS_SQL.replace("{x}", "x")}), '_'), lambda y: y <> ''), ' ')), ' '))) AS body_md5, len(humps) AS n_humps FROM i""")
def search_body(spark, d):
    """What full text search indexes of chunks with titles, symbols and paths."""
    k = F.col("doc_id")
    title, path = F.element_at(F.split("text", "\n"), 1), F.concat("source", F.lit("/docPage"), k, F.lit(".txt"))
    symbol = F.when(k % 3 == 0, F.concat(F.lit("retryDelay"), k % 7, F.lit(".HTTPServer_getURL")))
    head = F.concat_ws(" ", F.nullif(title, F.lit("")), symbol, path)
    humps = F.filter(T.identifiers(F.concat_ws(" ", head, "text")), lambda x: x.rlike(T.CAMEL))
    return table(spark, d, "documents").select("doc_id", F.md5(T.search_body(title, symbol, path, F.col("text"))).alias("body_md5"), F.size(humps).alias("n_humps"))


# ---- history: conversations as threads, their turns as passages -------------------------------
@R.query("SELECT conv_id, concat('Thread ', conv_id, chr(10), chr(10), string_agg(concat('--- ', role, ': ', text), concat(chr(10), chr(10)) ORDER BY turn)) AS body, count(*) AS n_comments FROM conversations GROUP BY conv_id")
def thread_assembly(spark, d):
    from lodestar.operators.chunking import assemble_threads

    return assemble_threads(table(spark, d, "conversations")).select("conv_id", "body", "n_comments")


HISTORY = {1: "the thing of eding", 2: "der die und", 3: "answer please question"}


@R.query(f"""WITH {bm25_sql(HISTORY).replace("doc_id AS id", "conv_id * 1000 + turn AS id").replace("FROM documents", "FROM conversations")},
r AS (SELECT query_id, id // 1000 AS thread, id, score, row_number() OVER (PARTITION BY query_id, id // 1000 ORDER BY score DESC, id) AS n FROM scored)
SELECT query_id, thread, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id % 1000 AS turn FROM r WHERE n = 1 QUALIFY rank <= 8""")
def history_search_best_passage(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"))
    own = I.InvertedIndex(stored(spark, d, "conversations", "turns", rows_of(I.build, turns)))
    hits = own.scores(terms(spark, HISTORY))
    hits = hits.select("query_id", "id", F.floor(F.col("id") / 1000).alias("thread"), F.lit(True).alias("is_passage"), "score")
    return X.regroup(hits, 8).select("query_id", "thread", F.col("shown_id").alias("id"), "score", "rank", (F.col("shown_id") % 1000).alias("turn"))


# ---- lines, symbols and reads -------------------------------------------------------------------
def lines(spark, d) -> DataFrame:
    """Documents as files: path, line (from 1), text."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.select("path", (F.col("pos") + 1).alias("line"), "text")


LINES_SQL = "lines AS (SELECT concat(source, '/', doc_id, '.txt') AS path, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


@R.query(rf"WITH {LINES_SQL}, h AS (SELECT * FROM lines WHERE regexp_matches(text, '(?i)\bthe \w+ing\b')) SELECT path, line, substr(trim(text, ' '), 1, 200) AS text, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, line LIMIT 40")
def grep_capped_with_total(spark, d):
    return X.grep(lines(spark, d), r"(?i)\bthe \w+ing\b")


@R.query(f"WITH {LINES_SQL} SELECT line, text FROM lines WHERE path = (SELECT min(path) FROM lines) AND line BETWEEN 2 AND 5")
def read_lines_range(spark, d):
    first = lines(spark, d).agg(F.min("path")).first()[0]
    return X.read_lines(lines(spark, d), "./" + first, 2, 5)


@R.query("SELECT conv_id, page, substr(body, page * 6000 + 1, 6000) AS text, CASE WHEN (page + 1) * 6000 < length(body) THEN (page + 1) * 6000 END AS next_offset FROM (SELECT *, unnest(range(CAST(ceil(length(body) / 6000.0) AS BIGINT))) AS page FROM (SELECT conv_id, string_agg(concat(role, ': ', repeat(text, 8)), concat(chr(10), chr(10)) ORDER BY turn) AS body FROM conversations GROUP BY conv_id))")
def read_page_offsets(spark, d):
    from lodestar.operators.chunking import pages

    rows = table(spark, d, "conversations").withColumn("text", F.repeat("text", 8))
    body = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    return pages(body, 6000)


SYMBOLS_SQL = "symbols AS (SELECT concat('f', doc_id % 40) AS name, concat(source, '.C', doc_id % 9, '.f', doc_id % 40) AS qualified_name, source AS path, doc_id % 300 + 1 AS start_line, doc_id % 300 + 1 + doc_id % 23 AS end_line FROM documents)"


def symbols(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat(F.lit("f"), k % 40).alias("name"), F.concat("source", F.lit(".C"), k % 9, F.lit(".f"), k % 40).alias("qualified_name"), F.col("source").alias("path"), (k % 300 + 1).alias("start_line"), (k % 300 + 1 + k % 23).alias("end_line"))


@R.query(f"WITH {SYMBOLS_SQL}, t AS (SELECT * FROM symbols WHERE name = 'f7') SELECT * FROM t WHERE suffix(qualified_name, 'C5.f7') ORDER BY length(qualified_name), qualified_name, path, start_line LIMIT 10")
def find_symbol_definitions(spark, d):
    return X.find_definitions(symbols(spark, d), "`C5.f7(x)`")


@R.query("SELECT concat('f', doc_id % 17) AS callee, concat('g', doc_id % 5) AS caller, source AS path, doc_id AS line FROM documents WHERE doc_id % 17 = 3 ORDER BY path, line, caller LIMIT 30")
def find_symbol_callers(spark, d):
    k = F.col("doc_id")
    calls = table(spark, d, "documents").select(F.concat(F.lit("f"), k % 17).alias("callee"), F.concat(F.lit("g"), k % 5).alias("caller"), F.col("source").alias("path"), k.alias("line"))
    return X.find_callers(calls, "mod.f3()")
