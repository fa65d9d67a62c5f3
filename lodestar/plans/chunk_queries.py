"""Chunking queries: windows, headings, runs, passages, sections, ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import chunking as C
from lodestar.operators import history as H
from lodestar.operators import ranges as G
from lodestar.plans.registry import Registry
from lodestar.plans.retrieval_queries import LINES_SQL, lines
from lodestar.session import table

R = Registry()


@R.query("""SELECT doc_id, s + 50 * k AS start_line, CASE WHEN n > 80 THEN least(s + 50 * k + 59, s + n - 1) ELSE s + n - 1 END AS end_line
FROM (SELECT *, unnest(CASE WHEN n > 80 THEN range(CAST(ceil((n - 60) / 50.0) AS BIGINT) + 1) ELSE [0] END) AS k FROM (SELECT doc_id, doc_id % 37 + 1 AS s, doc_id * 7 % 400 + 1 AS n FROM documents))""")
def line_windows(spark, d):
    k = F.col("doc_id")
    spans = table(spark, d, "documents").select("doc_id", (k % 37 + 1).alias("s"), (k % 37 + k * 7 % 400 + 1).alias("e"))
    return spans.select("doc_id", F.explode(C.line_windows(F.col("s"), F.col("e"))).alias("w")).select("doc_id", F.col("w.start").alias("start_line"), F.col("w.end").alias("end_line"))


#: Headings and fences are derived from line numbers, as the text has none.
MARKED_SQL = f"""{LINES_SQL}, marked AS (SELECT path, line, CASE WHEN line % 11 = 4 THEN '```' WHEN line % 3 = 0 THEN concat(repeat('#', CAST((line * 7) % 4 + 1 AS INTEGER)), ' ', substr(text, 1, 12), 'x', line, ' ##') ELSE text END AS text FROM lines),
fenced AS (SELECT *, regexp_matches(text, '^\\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(text, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) % 2 = 1 AS inside FROM marked),
heads AS (SELECT path, line, length(regexp_extract(text, '^(#{{1,4}})\\s+(.+?)\\s*#*\\s*$', 1)) AS level, trim(regexp_extract(text, '^(#{{1,4}})\\s+(.+?)\\s*#*\\s*$', 2), ' ') AS heading FROM fenced WHERE NOT fence AND NOT inside AND regexp_matches(text, '^(#{{1,4}})\\s+(.+?)\\s*#*\\s*$')),
opened AS (SELECT path, line, level, heading, {", ".join(f"max(CASE WHEN level <= {n} THEN struct_pack(i := line, v := level, h := heading) END) OVER w AS o{n}" for n in range(1, 5))} FROM heads WINDOW w AS (PARTITION BY path ORDER BY line)),
crumbs AS (SELECT path, line, level, heading, concat_ws(' > ', {", ".join(f"CASE WHEN o{n}.v = {n} AND {n} <= level THEN o{n}.h END" for n in range(1, 5))}) AS trail FROM opened),
ends AS (SELECT path, max(line) AS n FROM marked GROUP BY path),
secs AS (SELECT path, title, start, coalesce(lead(start) OVER (PARTITION BY path ORDER BY start) - 1, n) AS stop FROM (SELECT path, trail AS title, line AS start FROM crumbs UNION ALL SELECT path, NULL, 1 FROM ends WHERE path NOT IN (SELECT path FROM crumbs WHERE line = 1)) JOIN ends USING (path))"""


def marked(spark, d):
    n = F.col("line")
    heading = F.concat(F.repeat(F.lit("#"), (n * 7 % 4 + 1).cast("int")), F.lit(" "), F.substring("text", 1, 12), F.lit("x"), n, F.lit(" ##"))
    return lines(spark, d).select("path", "line", F.when(n % 11 == 4, "```").when(n % 3 == 0, heading).otherwise(F.col("text")).alias("text"))


@R.query(f"WITH {MARKED_SQL} SELECT path, line, level, heading, trail FROM crumbs")
def heading_breadcrumbs(spark, d):
    return C.breadcrumbs(C.headings(marked(spark, d))).select("path", "line", "level", "heading", "trail")


@R.query(f"WITH {MARKED_SQL} SELECT path, title, start, stop FROM secs")
def heading_sections(spark, d):
    return C.sections(marked(spark, d)).select("path", "title", "start", F.col("end").alias("stop"))


@R.query()
def merged_sections(spark, d):
    """Sections with small ones carried forward; a fold in order, held against a loop in the tests."""
    text = marked(spark, d)
    found = C.sections(text)
    sized = C.sized(found, text)
    return C.merge_small(sized.select("path", "title", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "size")).withColumnRenamed("end", "stop")


@R.query(f"""WITH {LINES_SQL}, kept AS (SELECT path, line, text FROM lines WHERE line % 13 NOT IN (3, 4)), runs AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM kept)
SELECT path, min(line) FILTER (WHERE regexp_matches(text, '\\S')) AS start, max(line) FILTER (WHERE regexp_matches(text, '\\S')) AS stop, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS n_full FROM runs GROUP BY path, run HAVING n_full >= 3""")
def module_runs(spark, d):
    kept = lines(spark, d).where("line % 13 not in (3, 4)")
    return C.islands(kept).select("path", "start", F.col("end").alias("stop"), "n_full")


PASSAGE_BODY_SQL = "SELECT conv_id AS id, string_agg(concat('--- ', role, ': ', text), concat(chr(10), chr(10)) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"
_TAKEN = "CASE WHEN length(p) > 1200 THEN CASE WHEN instr(reverse(substring(p, 601, 600)), chr(10)) > 0 THEN 1200 - instr(reverse(substring(p, 601, 600)), chr(10)) ELSE 1200 END ELSE length(p) END"


@R.query(f"""WITH RECURSIVE bodies AS ({PASSAGE_BODY_SQL}), parts AS (SELECT id, string_split(replace(body, concat(chr(10), chr(10), '--- '), concat(chr(1), '--- ')), chr(1)) AS xs FROM bodies WHERE length(body) > 1200),
segs AS (SELECT id, i, CAST(list_sum(list_transform(xs[1:i - 1], lambda x: length(x) + 2)) AS BIGINT) AS pos, concat(xs[i], CASE WHEN i < len(xs) THEN concat(chr(10), chr(10)) ELSE '' END) AS p FROM (SELECT id, xs, unnest(range(1, len(xs) + 1)) AS i FROM parts)),
cut AS (SELECT id, coalesce(pos, 0) AS pos, p, {_TAKEN} AS size FROM segs UNION ALL SELECT id, pos, p, {_TAKEN} FROM (SELECT id, pos + size AS pos, substring(p, size + 1) AS p FROM cut WHERE length(p) > size))
SELECT id, pos AS "offset", regexp_replace(substring(p, 1, size), '^\\s+|\\s+$', '', 'g') AS text FROM cut WHERE regexp_replace(substring(p, 1, size), '^\\s+|\\s+$', '', 'g') <> ''""")
def thread_passages(spark, d):
    turns = table(spark, d, "conversations")
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("--- "), "role", F.lit(": "), "text").alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    return C.passages(body.select(F.col("conv_id").alias("id"), "body"))


#: Whole documents as sections; every seventeenth line and some more are blank.
SPLIT_SQL = f"""{LINES_SQL}, spaced AS (SELECT path, line, CASE WHEN line % 17 = 5 OR line * 7 % 23 = 1 THEN ' ' ELSE text END AS text FROM lines),
blanks AS (SELECT path, line FROM spaced WHERE NOT regexp_matches(text, '\\S')), whole AS (SELECT path, max(line) AS stop FROM spaced GROUP BY path),
cuts AS (SELECT path, stop, CAST(1 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS last FROM whole
  UNION ALL SELECT path, stop, cut + 1, cut FROM (SELECT c.path, c.stop, coalesce(max(b.line), any_value(c.start) + 59) AS cut FROM cuts c LEFT JOIN blanks b ON b.path = c.path AND b.line BETWEEN c.start + 31 AND c.start + 59 WHERE c.stop - c.start + 1 > 60 GROUP BY c.path, c.stop, c.start))"""


@R.query(f"WITH RECURSIVE {SPLIT_SQL} SELECT path, start, coalesce(lead(start) OVER (PARTITION BY path ORDER BY start) - 1, stop) AS stop FROM cuts")
def split_sections(spark, d):
    n = F.col("line")
    spaced = lines(spark, d).select("path", "line", F.when((n % 17 == 5) | (n * 7 % 23 == 1), " ").otherwise(F.col("text")).alias("text"))
    whole = spaced.groupBy("path").agg(F.lit(1).cast("bigint").alias("start"), F.max("line").cast("bigint").alias("end"))
    return C.split_long(whole, spaced).select("path", "start", F.col("end").alias("stop"))


# ---- line ranges: definitions, calls, citations -------------------------------------------------
DEFS_SQL = "defs AS (SELECT doc_id AS def_id, source AS path, doc_id * 13 % 700 + 1 AS s, doc_id * 13 % 700 + 1 + doc_id * 31 % 97 AS e FROM documents)"
CALLS_SQL = "calls AS (SELECT doc_id AS call_id, source AS path, doc_id * 17 % 800 + 1 AS line FROM documents)"


def definitions(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(k.alias("def_id"), F.col("source").alias("path"), (k * 13 % 700 + 1).alias("start"), (k * 13 % 700 + 1 + k * 31 % 97).alias("end"))


def call_sites(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(k.alias("call_id"), F.col("source").alias("path"), (k * 17 % 800 + 1).alias("line"))


@R.query(f"WITH {DEFS_SQL}, {CALLS_SQL} SELECT call_id, calls.path, line, def_id FROM calls LEFT JOIN defs ON calls.path = defs.path AND line BETWEEN s AND e QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY e - s, def_id) = 1")
def innermost_enclosing(spark, d):
    return G.innermost(call_sites(spark, d), definitions(spark, d), "call_id").select("call_id", "path", "line", "def_id")


@R.query(f"WITH {DEFS_SQL}, {CALLS_SQL} SELECT call_id, path, line FROM calls WHERE NOT EXISTS (SELECT 1 FROM defs WHERE defs.path = calls.path AND line BETWEEN s AND e)")
def module_lines_anti_join(spark, d):
    return G.outside(call_sites(spark, d), definitions(spark, d), "call_id").select("call_id", "path", "line")


GOLD_SQL = "gold AS (SELECT item_id, concat('src', item_id % 20) AS path, item_id * 29 % 600 + 1 AS s, item_id * 29 % 600 + 40 AS e, item_id % 9 = 0 AS whole FROM benchmark)"


@R.query(f"WITH {DEFS_SQL}, {GOLD_SQL} SELECT def_id, path, s AS start_line, e AS end_line FROM defs WHERE EXISTS (SELECT 1 FROM gold WHERE gold.path = defs.path AND (whole OR gold.s <= defs.e AND defs.s <= gold.e))")
def range_overlap_gold(spark, d):
    k = F.col("item_id")
    gold = table(spark, d, "benchmark").select(k.alias("gold_id"), F.concat(F.lit("src"), k % 20).alias("path"), (k * 29 % 600 + 1).alias("start"), (k * 29 % 600 + 40).alias("end"), (k % 9 == 0).alias("whole"))
    return G.overlapping(definitions(spark, d), gold, "def_id").select("def_id", "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@R.query(f"WITH {DEFS_SQL}, q AS (SELECT item_id, concat('src', item_id % 20) AS path, item_id * 29 % 600 + 1 AS s, item_id * 29 % 600 + 90 AS e FROM benchmark) SELECT item_id, def_id, row_number() OVER (PARTITION BY item_id ORDER BY def_id DESC) AS n FROM q JOIN defs ON q.path = defs.path AND q.s <= defs.e AND defs.s <= q.e QUALIFY n <= 10")
def code_history_overlap(spark, d):
    """The newest ten hunks that touch each asked line range; ids stand for commit order."""
    k = F.col("item_id")
    asked = table(spark, d, "benchmark").select(k.alias("item_id"), F.col("item_id").alias("ask_id"), F.concat(F.lit("src"), k % 20).alias("path"), (k * 29 % 600 + 1).alias("start"), (k * 29 % 600 + 90).alias("end"))
    hits = G.overlap_pairs(asked, definitions(spark, d), "ask_id", "def_id")
    n = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("def_id")))
    return hits.withColumn("n", n).where("n <= 10").select(F.col("ask_id").alias("item_id"), "def_id", "n")


@R.query(f"WITH {DEFS_SQL}, {LINES_SQL.replace('doc_id, ', 'doc_id, ')}, b AS (SELECT def_id, lines.line, lines.text, row_number() OVER (PARTITION BY def_id ORDER BY line) AS n FROM defs JOIN documents ON doc_id = def_id JOIN lines ON lines.path = concat(source, '/', doc_id, '.txt') AND line BETWEEN def_id % 4 + 1 AND def_id % 4 + 3) SELECT def_id, line, text FROM b WHERE n <= 60")
def definition_bodies(spark, d):
    spans = table(spark, d, "documents").select(F.col("doc_id").alias("def_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), (F.col("doc_id") % 4 + 1).alias("start"), (F.col("doc_id") % 4 + 3).alias("end"))
    hits = G.points_in(lines(spark, d), spans)
    n = F.row_number().over(Window.partitionBy("def_id").orderBy("line"))
    return hits.withColumn("n", n).where("n <= 60").select("def_id", "line", "text")


#: Each document is a commit to its source's file with two hunks; the later hunk's old place follows from the earlier one.
HUNKS_SQL = """hunks AS (SELECT source AS path, doc_id AS seq, doc_id * 13 % 300 + 8 AS n1, doc_id % 7 AS m1, doc_id * 5 % 6 AS k1, doc_id * 11 % 300 + 400 AS n2, doc_id * 3 % 7 AS m2, doc_id % 5 AS k2 FROM documents),
placed AS (SELECT path, seq, unnest([{'new': n1, 'm': m1, 'k': k1, 'was': 0}, {'new': n2, 'm': m2, 'k': k2, 'was': m1 - k1}]) AS h FROM hunks),
commits AS (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS i, list({'low': 2 * h.new + CASE WHEN h.m = 0 THEN 1 ELSE 0 END, 'high': CASE WHEN h.m = 0 THEN 2 * h.new + 1 ELSE 2 * (h.new + h.m - 1) END, 'm': h.m, 'k': h.k,
  'first': h.new - h.was - CASE WHEN h.m > 0 AND h.k = 0 THEN 1 WHEN h.m = 0 AND h.k > 0 THEN -1 ELSE 0 END + CASE WHEN h.k = 0 THEN 1 ELSE 0 END,
  'last': h.new - h.was - CASE WHEN h.m > 0 AND h.k = 0 THEN 1 WHEN h.m = 0 AND h.k > 0 THEN -1 ELSE 0 END + greatest(h.k - 1, 0)} ORDER BY h.new) AS hs FROM placed WHERE h.m + h.k > 0 GROUP BY path, seq),
asks AS (SELECT item_id, concat('src', item_id % 20) AS path, item_id * 29 % 600 + 1 AS s, item_id * 29 % 600 + 1 + item_id % 9 AS e FROM benchmark),
walk AS (SELECT item_id, path, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, false AS hit, CAST(NULL AS BIGINT) AS at_s, CAST(NULL AS BIGINT) AS at_e, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM asks
  UNION ALL SELECT item_id, w.path, c.i, c.seq, n + CASE WHEN len(list_filter(hs, lambda h: h.low <= 2 * e AND h.high >= 2 * s)) > 0 THEN 1 ELSE 0 END, len(list_filter(hs, lambda h: h.low <= 2 * e AND h.high >= 2 * s)) > 0, s, e,
  CAST(coalesce(list_filter(hs, lambda h: h.low <= 2 * s AND h.high >= 2 * s)[1].first, s + coalesce(list_sum(list_transform(list_filter(hs, lambda h: h.high < 2 * s), lambda h: h.k - h.m)), 0)) AS BIGINT),
  CAST(coalesce(list_filter(hs, lambda h: h.low <= 2 * e AND h.high >= 2 * e)[1].last, e + coalesce(list_sum(list_transform(list_filter(hs, lambda h: h.high < 2 * e), lambda h: h.k - h.m)), 0)) AS BIGINT)
  FROM walk w JOIN commits c ON c.path = w.path AND c.i = w.i + 1 WHERE w.s <= w.e AND w.n < 10)"""


@R.query(f"WITH RECURSIVE {HUNKS_SQL} SELECT item_id, n, seq, at_s AS start, at_e AS stop FROM walk WHERE hit")
def line_history(spark, d):
    """The newest ten commits that changed each asked range, which moves and widens on its way back."""
    k = F.col("doc_id")
    hunk = lambda new, m, o, was: F.struct((new - was - F.when((m > 0) & (o == 0), 1).when((m == 0) & (o > 0), -1).otherwise(0)).alias("old_start"), o.alias("old_lines"), new.alias("new_start"), m.alias("new_lines"))
    both = F.array(hunk(k * 13 % 300 + 8, k % 7, k * 5 % 6, F.lit(0)), hunk(k * 11 % 300 + 400, k * 3 % 7, k % 5, k % 7 - k * 5 % 6))
    hunks = table(spark, d, "documents").select(F.col("source").alias("path"), k.alias("seq"), F.explode(both).alias("h")).select("path", "seq", "h.*").where("old_lines + new_lines > 0")
    i = F.col("item_id")
    asked = table(spark, d, "benchmark").select(i.alias("ask_id"), F.concat(F.lit("src"), i % 20).alias("path"), (i * 29 % 600 + 1).alias("start"), (i * 29 % 600 + 1 + i % 9).alias("end"))
    return H.line_history(asked, hunks).select(F.col("ask_id").alias("item_id"), "n", "seq", "start", F.col("end").alias("stop"))
