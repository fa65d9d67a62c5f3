"""Queries over text functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.plans.registry import Registry
from lodestar.session import table

R = Registry()
#: Identifiers and references are made of row values: the tables' own text has none.
NAME_SQL = "concat('parse', upper(lang), 'Source_', source, 'HTTPChunk', doc_id)"
SPLIT_SQL = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')), '_'), lambda y: y <> '')"
TOKENS_SQL = rf"list_filter(string_split_regex(translate(lower({{x}}), '{T.MARKED}', '{T.PLAIN}'), '[^\p{{{{L}}}}\p{{{{N}}}}\p{{{{Co}}}}]+'), lambda y: y <> '')".replace("{{", "{").replace("}}", "}")


def made_name():
    """An identifier made of a row's values."""
    return F.concat(F.lit("parse"), F.upper("lang"), F.lit("Source_"), F.col("source"), F.lit("HTTPChunk"), F.col("doc_id"))


def tokens_sql(x: str) -> str:
    return TOKENS_SQL.replace("{x}", x)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@R.query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_unicode61(spark, d):
    t = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@R.query(f"SELECT doc_id, array_to_string({SPLIT_SQL.replace('{x}', NAME_SQL)}, ' ') AS parts FROM documents")
def split_identifiers(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.split_identifier(made_name()), " ").alias("parts"))


@R.query(r"SELECT page_id, len(t) AS n_identifiers, len(list_distinct(t)) AS n_distinct, sha256(array_to_string(t, ' ')) AS identifiers_sha FROM (SELECT page_id, regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*') AS t FROM pages)")
def identifier_scan(spark, d):
    t = table(spark, d, "pages").select("page_id", T.identifiers(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").cast("bigint").alias("n_identifiers"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("identifiers_sha"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@R.query(rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(array_to_string(regexp_extract_all(concat('Why does ', {NAME_SQL}, ' of the module wait? '), '[A-Za-z_][A-Za-z0-9_]*'), '_')), '_'), lambda y: y <> '') AS w,
  array_to_string(regexp_extract_all(concat('Why does ', {NAME_SQL}, ' of the module wait?'), '[A-Za-z_][A-Za-z0-9_]*'), '_') AS j FROM documents),
u AS (SELECT doc_id, {SPLIT_SQL.replace("{x}", "j")} AS p FROM t),
v AS (SELECT doc_id, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_position(p, p[i]) = i AND NOT list_contains({STOP_SQL}, p[i]) AND length(p[i]) > 1 THEN p[i] END) AS q FROM u)
SELECT doc_id, array_to_string(list_transform(list_filter(q, lambda y: y IS NOT NULL), lambda y: concat('"', y, '"')), ' OR ') AS expression FROM v""")
def fts_query_terms(spark, d):
    question = F.concat(F.lit("Why does "), made_name(), F.lit(" of the module wait?"))
    return docs(spark, d).select("doc_id", T.match_expression(question).alias("expression"))


@R.query(r"SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '^\s+|\s+$', '', 'g') AS t FROM pages)")
def strip_html_comments(spark, d):
    return table(spark, d, "pages").select("page_id", T.without_comments(F.col("html")).alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


QUOTE_SQL = r"regexp_replace(regexp_replace(translate(lower({x}), '’“”`*_>#', '''\"\"'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')".replace('\\"', '"')
MARKED_UP_SQL = "concat('> **“', substr(text, 1, 200), '”** `x_y`#', chr(10), chr(10), '  it’s. . ')"


@R.query(f"SELECT doc_id, {QUOTE_SQL.replace('{x}', MARKED_UP_SQL)} AS quote FROM documents")
def normalise_quote_text(spark, d):
    marked = F.concat(F.lit("> **“"), F.substring("text", 1, 200), F.lit("”** `x_y`#\n\n  it’s. . "))
    return docs(spark, d).select("doc_id", T.quote_form(marked).alias("quote"))


@R.query("""SELECT doc_id, ref, CASE WHEN instr(b, '#L') > 0 THEN replace(concat(substr(b, 1, instr(b, '#L') - 1), ':', substr(b, instr(b, '#L') + 2)), '-L', '-') ELSE b END AS normal
FROM (SELECT doc_id, ref, trim(ref, ' `[]()') AS b FROM (SELECT doc_id, concat('  `[', source, '/m', doc_id, '.py#L', doc_id % 50 + 1, '-L', doc_id % 50 + 9, ']` ') AS ref FROM documents))""")
def normalise_refs(spark, d):
    ref = F.concat(F.lit("  `["), F.col("source"), F.lit("/m"), F.col("doc_id"), F.lit(".py#L"), F.col("doc_id") % 50 + 1, F.lit("-L"), F.col("doc_id") % 50 + 9, F.lit("]` "))
    return docs(spark, d).select("doc_id", ref.alias("ref")).withColumn("normal", T.normal_ref(F.col("ref")))


@R.query(r"""SELECT doc_id, regexp_extract(ref, '^(.+?):(\d+)(?:-(\d+))?$', 1) AS path, CAST(regexp_extract(ref, '^(.+?):(\d+)(?:-(\d+))?$', 2) AS BIGINT) AS start_line,
 CASE WHEN regexp_extract(ref, '^(.+?):(\d+)(?:-(\d+))?$', 3) = '' THEN CAST(regexp_extract(ref, '^(.+?):(\d+)(?:-(\d+))?$', 2) AS BIGINT) ELSE CAST(regexp_extract(ref, '^(.+?):(\d+)(?:-(\d+))?$', 3) AS BIGINT) END AS end_line
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(source, '/m.py:', doc_id % 90 + 1) ELSE concat(source, '/m.py:', doc_id % 90 + 1, '-', doc_id % 90 + 7) END AS ref FROM documents)""")
def range_ref_parse(spark, d):
    short = F.concat(F.col("source"), F.lit("/m.py:"), F.col("doc_id") % 90 + 1)
    ref = F.when(F.col("doc_id") % 3 == 0, short).otherwise(F.concat(short, F.lit("-"), F.col("doc_id") % 90 + 7))
    path, start, end = T.ref_range(F.col("ref"))
    return docs(spark, d).select("doc_id", ref.alias("ref")).select("doc_id", path.alias("path"), start.alias("start_line"), end.alias("end_line"))


LINKS_SQL = r"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '{p}', 1), lambda y: CAST(y AS BIGINT))))"
LINK_TEXT_SQL = "concat('Fix (#', doc_id, ') and #', doc_id % 7, ', see a/b#12, #', doc_id, ' x#5 #', doc_id % 11)"


@R.query(f"SELECT doc_id, array_to_string({LINKS_SQL.replace('{x}', LINK_TEXT_SQL).replace('{p}', r'(?:^|[^A-Za-z0-9_/])#([0-9]+)')}, ',') AS thread_links, array_to_string({LINKS_SQL.replace('{x}', LINK_TEXT_SQL).replace('{p}', r'(?:^|[( ])#([0-9]+)')}, ',') AS commit_links FROM documents")
def linked_refs(spark, d):
    text = F.concat(F.lit("Fix (#"), F.col("doc_id"), F.lit(") and #"), F.col("doc_id") % 7, F.lit(", see a/b#12, #"), F.col("doc_id"), F.lit(" x#5 #"), F.col("doc_id") % 11)
    return docs(spark, d).select("doc_id", F.array_join(T.linked_numbers(text).cast("array<string>"), ",").alias("thread_links"), F.array_join(T.linked_numbers(text, False).cast("array<string>"), ",").alias("commit_links"))


@R.query("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 4 < 3 THEN [r, concat('release:', t), concat('release:v', ltrim(t, 'v')), concat('release:', ltrim(t, 'v'))] ELSE [r] END, '|') AS candidates
FROM (SELECT doc_id, r, CASE WHEN doc_id % 4 = 2 THEN substr(r, 9) ELSE r END AS t FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('v', doc_id, '.0.1') WHEN 1 THEN concat(doc_id, '.2.0') WHEN 2 THEN concat('release:v', doc_id, '.1') ELSE concat('PR#', doc_id) END AS r FROM documents))""")
def release_aliases(spark, d):
    k = F.col("doc_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("v"), k, F.lit(".0.1"))).when(k % 4 == 1, F.concat(k, F.lit(".2.0"))).when(k % 4 == 2, F.concat(F.lit("release:v"), k, F.lit(".1"))).otherwise(F.concat(F.lit("PR#"), k))
    return docs(spark, d).select("doc_id", F.array_join(T.release_candidates(ref), "|").alias("candidates"))


@R.query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(m, lambda y: y < 1 OR y > 3), lambda y: CAST(y AS VARCHAR)), ',') AS out_of_range, len(m) AS n_markers
FROM (SELECT doc_id, list_transform(regexp_extract_all(concat('It waits [1], then [', doc_id % 6, '] and [', doc_id % 4, '].'), '\[(\d+)\]', 1), lambda y: CAST(y AS BIGINT)) AS m FROM documents)""")
def citation_markers(spark, d):
    answer = F.concat(F.lit("It waits [1], then ["), F.col("doc_id") % 6, F.lit("] and ["), F.col("doc_id") % 4, F.lit("]."))
    m = docs(spark, d).select("doc_id", T.markers(answer).alias("m"))
    return m.select("doc_id", F.array_join(F.filter("m", lambda y: (y < 1) | (y > 3)).cast("array<string>"), ",").alias("out_of_range"), F.size("m").cast("bigint").alias("n_markers"))


@R.query(r"SELECT doc_id, CASE WHEN len(v) = 3 THEN array_to_string(list_transform(v, lambda y: CASE WHEN y = 'YES' THEN 'true' ELSE 'false' END), ',') END AS verdict FROM (SELECT doc_id, regexp_extract_all(upper(CASE WHEN doc_id % 5 = 0 THEN '1. yes 2. maybe 3. No' ELSE concat('1. yes', chr(10), '2. ', CASE WHEN doc_id % 2 = 0 THEN 'No' ELSE 'YES' END, ' 3. no') END), '\b(YES|NO)\b') AS v FROM documents)")
def judge_verdicts(spark, d):
    reply = F.when(F.col("doc_id") % 5 == 0, "1. yes 2. maybe 3. No").otherwise(F.concat(F.lit("1. yes\n2. "), F.when(F.col("doc_id") % 2 == 0, "No").otherwise("YES"), F.lit(" 3. no")))
    return docs(spark, d).select("doc_id", F.array_join(T.verdicts(reply, F.lit(3)).cast("array<string>"), ",").alias("verdict"))


@R.query("""SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN NULL ELSE source END AS owner, CASE doc_id % 6 WHEN 5 THEN NULL ELSE concat('lib', doc_id) END AS name FROM documents""")
def repo_url_parse(spark, d):
    full = F.concat(F.col("source"), F.lit("/lib"), F.col("doc_id"))
    k = F.col("doc_id") % 6
    url = F.when(k == 0, full).when(k == 1, F.concat(F.lit("https://host.example/"), full)).when(k == 2, F.concat(F.lit("https://host.example/"), full, F.lit(".git"))).when(k == 3, F.concat(F.lit("git@host.example:"), full, F.lit(".git"))).when(k == 4, F.concat(F.lit("https://host.example/"), full, F.lit("/"))).otherwise(F.concat(F.lit("not a repo "), full))
    owner, name = T.repo_parts(url)
    return docs(spark, d).select("doc_id", owner.alias("owner"), name.alias("name"))


@R.query("SELECT doc_id, sha256(concat('model-a', chr(0), text)) AS cache_key FROM documents")
def embedding_cache_keys(spark, d):
    return docs(spark, d).select("doc_id", T.cache_key(F.lit("model-a"), F.col("text")).alias("cache_key"))


WHY_SQL = "concat(CASE doc_id % 5 WHEN 0 THEN 'Why is ' WHEN 1 THEN 'What is the rationale of ' WHEN 2 THEN 'Where is ' WHEN 3 THEN 'Which trade-offs has ' ELSE 'What motivated ' END, source, doc_id, '?')"


@R.query(rf"SELECT doc_id, q AS question FROM (SELECT doc_id, {WHY_SQL} AS q FROM documents) WHERE regexp_matches(q, '\bwhy\b|\breasons?\b|\brationale\b|\bmotivat|\btrade-?offs?\b', 'i')")
def rationale_filter(spark, d):
    k = F.col("doc_id") % 5
    start = F.when(k == 0, "Why is ").when(k == 1, "What is the rationale of ").when(k == 2, "Where is ").when(k == 3, "Which trade-offs has ").otherwise("What motivated ")
    return docs(spark, d).select("doc_id", F.concat(start, "source", "doc_id", F.lit("?")).alias("question")).where(F.col("question").rlike(T.RATIONALE))


PATH_SQL = "concat(CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'Tests/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'docs/' WHEN 4 THEN '' ELSE 'lib/inner/' END, CASE doc_id % 7 WHEN 0 THEN 'mod' WHEN 1 THEN 'test_mod' WHEN 2 THEN 'README' WHEN 3 THEN 'a.spec' WHEN 4 THEN 'mod_test' WHEN 5 THEN 'conftest' ELSE 'x.min' END, CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' WHEN 4 THEN '.go' WHEN 5 THEN '.rst' WHEN 6 THEN '.json' ELSE '.ts' END)"


def _path():
    def pick(n, *names):
        out = F.lit(names[-1])
        for i, x in reversed(list(enumerate(names[:-1]))):
            out = F.when(F.col("doc_id") % n == i, x).otherwise(out)
        return out

    return F.concat(pick(6, "src/", "Tests/", "node_modules/", "docs/", "", "lib/inner/"), pick(7, "mod", "test_mod", "README", "a.spec", "mod_test", "conftest", "x.min"), pick(8, ".py", ".js", ".md", ".txt", ".go", ".rst", ".json", ".ts"))


@R.query(rf"""WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents), q AS (SELECT *, regexp_extract(path, '[^/]+$') AS f, regexp_extract(path, '\.[^.]+$') AS s,
 (path LIKE 'Tests/%' OR regexp_matches(lower(regexp_extract(path, '[^/]+$')), '^test_|_test\.(py|go|rs)$|^conftest\.py$|\.test\.|\.spec\.')) AS is_test FROM p)
SELECT doc_id, path, is_test, coalesce(s IN ('.py', '.js', '.go', '.ts') AND f <> 'x.min.js' AND path NOT LIKE 'node_modules/%' AND NOT is_test, false) AS is_source,
 NOT is_test AND (s IN ('.md', '.rst') AND path NOT LIKE 'node_modules/%' OR f = 'README.txt') AS is_document FROM q""")
def indexable_paths(spark, d):
    p = docs(spark, d).select("doc_id", _path().alias("path"))
    return p.select("doc_id", "path", T.is_test_path(F.col("path")).alias("is_test"), F.coalesce(T.is_source(F.col("path")), F.lit(False)).alias("is_source"), T.is_document(F.col("path")).alias("is_document"))


@R.query(f"WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents) SELECT path, total FROM (SELECT DISTINCT path, count(*) OVER () AS total FROM (SELECT DISTINCT path FROM p WHERE path GLOB '*[rb]/*.rst')) ORDER BY path LIMIT 200")
def glob_list(spark, d):
    hit = docs(spark, d).select(_path().alias("path")).where(F.col("path").rlike(T.glob_regex("*[rb]/*.rst"))).distinct()
    return hit.orderBy("path").limit(200).crossJoin(F.broadcast(hit.agg(F.count(F.lit(1)).alias("total"))))


@R.query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 30 AS DOUBLE) + 1.5 WHEN 1 THEN least(15.0 * (doc_id % 9), 90.0) WHEN 2 THEN NULL ELSE CAST(doc_id % 30 AS DOUBLE) + 1 END AS delay FROM documents")
def retry_delays(spark, d):
    k, n = F.col("doc_id") % 4, F.col("doc_id") % 30
    message = F.when(k == 0, F.concat(F.lit("429: Please retry in "), n, F.lit(".5s."))).when(k == 1, "503 unavailable").when(k == 2, "quota per day exceeded, retry in 3s").otherwise(F.concat(F.lit('"retryDelay": "'), n, F.lit('s"')))
    return docs(spark, d).select("doc_id", T.retry_delay(message, (F.col("doc_id") % 9).cast("double")).alias("delay"))


@R.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"k\":', json_extract(props, '$.k'), ',\"user\":', user_id, '}') AS encoded FROM events")
def event_json_codec(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("user"))).alias("encoded"))


@R.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, substr(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 1, 10) AS day FROM events WHERE ts <= (SELECT quantile_disc(ts, 0.5) FROM events)")
def as_of_cutoff(spark, d):
    events = table(spark, d, "events")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts as timestamp)))").cast("bigint").alias("cutoff"))
    kept = events.crossJoin(F.broadcast(middle)).where(F.expr("unix_micros(cast(ts as timestamp)) <= cutoff"))  # one row
    return kept.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")).withColumn("day", F.substring("iso", 1, 10))
