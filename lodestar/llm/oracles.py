"""DuckDB SQL for those of the queries that SQL can express.

The others need a tokenizer, Unicode normalisation, trees, fuzzy matching, divergences or a genetic
search; the tests hold them against brute force.
"""

from __future__ import annotations

from lodestar.llm.queries import RULES

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("{x}", f"translate(coalesce(text, ''), '{_A}', '{_Z}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * c >= 85 * (nx + ny - c)),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id, root = doc_id AS kept FROM s JOIN c ON node = doc_id"""

SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS.replace("{x}", "coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= n THEN array_to_string(ws[i:i + 19], ' ') END AS span FROM t),
d AS (SELECT doc_id, i, word, span IS NOT NULL AND row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(count(*) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id, len(ws)"""


def _rule_sql(value) -> str:
    order = sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in order) + " END"


def _split(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{_A}', '{_Z}'), '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path"


#: An address, whatever its case of scheme and host, the scheme's own port, its fragment or an empty path.
_SCHEME = f"translate(regexp_extract(split_part(url, '#', 1), '^(.*?)://', 1), '{_A}', '{_Z}')"
_REST = "regexp_extract(split_part(url, '#', 1), '^.*?://[^/?]*(.*)$', 1)"
_FORM = f"CASE WHEN instr(url, '://') > 0 THEN concat({_SCHEME}, '://', CASE WHEN {_SCHEME} = 'http' THEN regexp_replace(host, ':80$', '') WHEN {_SCHEME} = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END, CASE WHEN starts_with({_REST}, '/') THEN '' ELSE '/' END, {_REST}) END"
_FORMS = f"SELECT *, {_FORM} AS form FROM (SELECT *, {_split('url')} FROM"
_HIDDEN = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{x}\b.*?(?:</{x}\b|$)" for x in ("script", "style", "title", "textarea", "template"))
_TOKEN = r"""(>)|([^\s"''<>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""
_CODE = "CASE WHEN starts_with(lower(y), '&#x') THEN try_cast(concat('0x', regexp_extract(y, '(?i)^&#x0*([0-9a-f]{1,6});$', 1)) AS INTEGER) ELSE try_cast(regexp_extract(y, '^&#0*([0-9]{1,7});$', 1) AS INTEGER) END"
_LETTER = f"CASE y WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN chr(39) ELSE CASE WHEN regexp_matches(y, '(?i)^&#(?:[0-9]+|x[0-9a-f]+);$') AND {_CODE} BETWEEN 1 AND 1114111 THEN chr({_CODE}) ELSE y END END"
_PLAIN = rf"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(v, '^["'']|["'']$', '', 'g'), '&', chr(1) || '&', 'g'), ';', ';' || chr(1), 'g'), chr(1)), lambda y: {_LETTER}), '')"""


def _value(name: str) -> str:
    return f"CASE WHEN list_position(ns, '{name}') > 0 THEN vs[list_position(ns, '{name}')] END"


_KEPT = "list_reduce(list_transform(list_filter(string_split(regexp_replace(whole, '^/', ''), '/'), lambda s: s <> '.'), lambda s: [s]), lambda done, s: CASE WHEN s[1] = '..' THEN done[1:len(done) - 1] ELSE list_concat(done, s) END, CAST([] AS VARCHAR[]))"
_DOTS = rf"concat('/', array_to_string({_KEPT}, '/'), CASE WHEN regexp_matches(whole, '(?:^|/)\.\.?$') AND len({_KEPT}) > 0 THEN '/' ELSE '' END)"
_LINKS = rf"""raw AS (SELECT url AS source, unnest(list_filter(string_split(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '<')[2:], lambda x: regexp_matches(x, '(?i)^(?:link|meta)[\s/>]'))) AS piece FROM pages),
tokens AS (SELECT source, regexp_extract_all(piece, '{_TOKEN}', 1) AS stops, regexp_extract_all(piece, '{_TOKEN}', 2) AS names, regexp_extract_all(piece, '{_TOKEN}', 3) AS vals FROM raw),
tags AS (SELECT source, lower(names[1]) AS tag, list_transform(names[2:list_position(stops, '>') - 1], lambda n: translate(n, '{_A}', '{_Z}')) AS ns, list_transform(vals[2:list_position(stops, '>') - 1], lambda v: {_PLAIN}) AS vs FROM tokens WHERE list_position(stops, '>') > 1),
told AS (SELECT source, CASE WHEN tag = 'link' AND list_contains(regexp_split_to_array(translate({_value("rel")}, '{_A}', '{_Z}'), '\s+'), 'canonical') THEN regexp_replace({_value("href")}, '^\s+|\s+$', '', 'g')
  WHEN tag = 'meta' AND translate(regexp_replace({_value("http-equiv")}, '^\s+|\s+$', '', 'g'), '{_A}', '{_Z}') = 'refresh' THEN regexp_replace(regexp_extract({_value("content")}, '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"'']*)', 1), '^\s+|\s+$', '', 'g') END AS t FROM tags),
bases AS (SELECT *, regexp_extract(source, '^[^/?#]*://[^/?#]*') AS site, regexp_extract(source, '^[^/?#]*://[^/?#]*((?:/[^/?#]*)*/)', 1) AS folder, regexp_extract(t, '^[^?#]*') AS tp, regexp_extract(t, '[?#].*$') AS tr FROM told WHERE t IS NOT NULL AND t <> '' AND source IS NOT NULL),
paths AS (SELECT *, CASE WHEN starts_with(t, '/') THEN tp ELSE concat(CASE WHEN folder = '' THEN '/' ELSE folder END, tp) END AS whole FROM bases),
k AS (SELECT * FROM (SELECT source, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN instr(t, '://') > 0 THEN t END WHEN site = '' THEN NULL WHEN starts_with(t, '//') THEN concat(regexp_extract(source, '^[^:/?#]*:'), t)
  WHEN starts_with(t, '?') THEN concat(regexp_extract(source, '^[^?#]*'), t) WHEN starts_with(t, '#') THEN concat(regexp_extract(source, '^[^#]*'), t) ELSE concat(site, {_DOTS}, tr) END AS target FROM paths) WHERE target IS NOT NULL)"""

URLS = f"""WITH RECURSIVE p AS ({_FORMS} (SELECT page_id, url FROM pages)) t), {_LINKS},
a AS (SELECT form, row_number() OVER () AS i FROM ({_FORMS} (SELECT source AS url FROM k)) t)), b AS (SELECT form, row_number() OVER () AS i FROM ({_FORMS} (SELECT target AS url FROM k)) t)),
e AS (SELECT a.form AS x, b.form AS y FROM a JOIN b USING (i) WHERE a.form <> b.form), l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, root) AS (SELECT x, x FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
q AS (SELECT p.*, coalesce(root, form) AS component, {_rule_sql(lambda r: r.name)} AS rule, {_rule_sql(lambda r: r.verdict)} AS own FROM p LEFT JOIN c ON node = form),
n AS (SELECT coalesce(root, form) AS component, host, path FROM ({_FORMS} (SELECT source AS url FROM k UNION SELECT target FROM k)) t) LEFT JOIN c ON node = form WHERE form IS NOT NULL),
v AS (SELECT component, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM (SELECT component, own FROM q UNION ALL SELECT component, {_rule_sql(lambda r: r.verdict)} FROM n) WHERE own IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, q.component FROM q LEFT JOIN v ON v.component = q.component"""


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {"op3_near_duplicates": NEAR, "op4_substring_dedup": SUBSTRING, "op5_url_filter": URLS}
