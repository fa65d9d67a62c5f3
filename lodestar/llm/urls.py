"""URL filters with redirect equivalence, in DataFrame operations alone.

Redirects and canonical links are edges between addresses; their connected components are found by
distributed star contraction. Addresses are one only where they are the same by definition: whatever
the case of scheme and host, the scheme's own port, the fragment, or a missing path instead of /. A
component with an explicit block passes it on to those of its addresses that no rule fits, unless it
also has an explicit allow: that takes precedence. An address that a rule fits keeps that rule's verdict.

Links are read from tags as a browser reads them: not in comments, scripts, styles, titles, templates
or text areas, by whole attribute names, with quoted values, character references, and rel as a list.

Defined results: a null address, or one without ://, has an empty host and path, fits no rule, and
is allowed; repeated rows each keep their row; null edges are ignored; an empty table gives an empty
result. At most MOST_RULES rules are part of the plan; more are joined, by the suffixes of a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.graph import connected_components
from lodestar.session import cut

MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits; of equally long ones an allow comes first."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in order]
    return F.coalesce(*[F.when(fit, F.lit(value(r))) for fit, r in zip(fits, order, strict=True)], F.lit(None).cast("string"))


def fitted(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows (host, path, any others) with rule and own: name and verdict of the longest rule that fits; null if none does."""
    if len(rules) <= MOST_RULES:
        return rows.withColumns({"rule": fitting(rules, F.col("host"), F.col("path"), lambda r: r.name), "own": fitting(rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "suffix string, start string, name string, verdict string")
    pairs = cut(rows.select("host", "path").distinct())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("name", "verdict"), F.struct(F.length("name"), F.col("verdict") == "allow", "name"))
    found = hits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.name").alias("rule"), F.col("b.verdict").alias("own"))
    return rows.join(found, ["host", "path"], "left").select(*rows.columns, "rule", "own")


def address(url: Column) -> Column:
    """One spelling for all that are the same address by definition; null for null or without ://."""
    whole = F.regexp_extract(url, "^[^#]*", 0)
    scheme = F.translate(F.regexp_extract(whole, "^(.*?)://", 1), _UPPER, _LOWER)
    host, _ = host_and_path(url)
    bare = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(whole, "^.*?://[^/?]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), bare, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


#: The named character references that stand for characters of markup.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def without_references(text: Column) -> Column:
    """text with numeric character references and those of markup's own characters decoded, once."""

    def one(x: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(x, "(?i)^&#x0*([0-9a-f]{1,6});$", 1), 16, 10)
        number = F.when(x.rlike("(?i)^&#x"), hexadecimal).otherwise(F.regexp_extract(x, "^&#0*([0-9]{1,7});$", 1)).try_cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        out = F.when(x.rlike("(?i)^&#(?:[0-9]+|x[0-9a-f]+);$") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), letter)
        for name, c in _NAMED.items():
            out = out.when(x == f"&{name};", F.lit(c))
        return out.otherwise(x)

    return F.array_join(F.transform(F.split(text, r"(?=&)|(?<=;)"), one), "")


def resolved(links: DataFrame) -> DataFrame:
    """(source, target) of links (source, target): the address that each target means on its page; those that mean none are left out.

    Every step has a name: an expression that stands in another several times is planned as often.
    """
    target, base = F.col("target"), F.col("source")
    rows = links.where("source is not null and target <> ''").select(
        "source", "target", F.regexp_extract(base, "^[^/?#]*://[^/?#]*", 0).alias("site"), F.regexp_extract(base, "^[^/?#]*://[^/?#]*((?:/[^/?#]*)*/)", 1).alias("folder"),
        F.regexp_extract(target, "^[^?#]*", 0).alias("path"), F.regexp_extract(target, "[?#].*$", 0).alias("rest"),
    )
    rows = rows.withColumn("path", F.when(target.startswith("/"), F.col("path")).otherwise(F.concat(F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), "path")))
    # Without . and .. segments; such an end stands for a folder.
    kept = F.aggregate(
        F.filter(F.split(F.regexp_replace("path", "^/", ""), "/"), lambda x: x != "."),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    rows = rows.withColumns({"kept": kept, "folder_end": F.regexp_extract("path", r"(?:^|/)\.\.?$", 0) != ""})
    plain = F.concat(F.lit("/"), F.array_join("kept", "/"), F.when(F.col("folder_end") & (F.size("kept") > 0), F.lit("/")).otherwise(F.lit("")))
    relative = (
        F.when(target.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]*:", 0), target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), target))
        .otherwise(F.concat("site", plain, "rest"))
    )
    meant = F.when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(F.instr(target, "://") > 0, target)).when(F.col("site") != "", relative)
    return rows.select("source", meant.alias("target")).where("target is not null")


#: What holds no tags that count; unclosed, it reaches to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|textarea|template)\b.*?(?:</\1\b|\z)"
#: The end of a tag, or an attribute with its name and value.
_TOKEN = r"""(>)|([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def tags(pages: DataFrame, names: str) -> DataFrame:
    """(source, tag, names, values) of the tags of pages (url, html) that names (a|b) lists; attribute names in lower case, values without quotes and references."""
    pieces = F.split(F.regexp_replace("html", _HIDDEN, " "), "<")
    found = pages.select(F.col("url").alias("source"), F.explode(F.filter(F.slice(pieces, 2, F.size(pieces)), lambda x: x.rlike(rf"(?i)^(?:{names})[\s/>]"))).alias("piece"))
    part = lambda i: F.regexp_extract_all("piece", F.lit(_TOKEN), F.lit(i))
    read = found.select("source", part(1).alias("ends"), part(2).alias("names"), part(3).alias("values"))
    upto = F.greatest(F.array_position("ends", F.lit(">")) - 1, F.lit(0)).cast("int")  # a tag that does not close is none
    own = read.select("source", F.slice("names", 1, upto).alias("names"), F.slice("values", 1, upto).alias("values")).where(F.size("names") > 0)
    plain = lambda v: without_references(F.regexp_replace(v, r"""^["']|["']$""", ""))
    lower = F.transform("names", lambda n: F.translate(n, _UPPER, _LOWER))
    return own.select("source", F.try_element_at(lower, F.lit(1)).alias("tag"), F.slice(lower, 2, F.size(lower)).alias("names"), F.slice(F.transform("values", plain), 2, F.size(lower)).alias("values"))


def attribute(name: str) -> Column:
    """The first value of an attribute of rows with names and values; null without it."""
    return F.try_element_at("values", F.nullif(F.array_position("names", F.lit(name)).cast("int"), F.lit(0)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses of all canonical links and refresh redirects in pages (url, html)."""
    found = tags(pages, "link|meta")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rel = F.array_contains(F.split(F.translate(attribute("rel"), _UPPER, _LOWER), r"\s+"), "canonical")
    refresh = F.translate(trimmed(attribute("http-equiv")), _UPPER, _LOWER) == "refresh"
    told = F.regexp_extract(attribute("content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    target = F.when((F.col("tag") == "link") & rel, trimmed(attribute("href"))).when((F.col("tag") == "meta") & refresh, trimmed(told))
    return resolved(found.select("source", target.alias("target")))


def url_filter(pages: DataFrame, rules: list[Rule], links: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, component for each row of pages (page_id, url).

    links: two columns of addresses that redirect or point to each other. verdict is the longest
    fitting rule's; without one it is the component's. component is the smallest address of what the
    links connect; null for an address without ://.
    """
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("form"))
    rows = fitted(placed, rules)
    links = cut(links)  # read from whole pages, and used several times
    a, b = links.columns[:2]
    parts = connected_components(links.select(address(F.col(a)).alias("a"), address(F.col(b)).alias("b")))
    rows = rows.join(parts.withColumnRenamed("node", "form"), "form", "left").withColumn("component", F.coalesce("component", "form"))
    # Explicit verdicts of each component; targets that are no page themselves count too.
    ends = links.select(F.explode(F.array(F.col(a).cast("string"), F.col(b).cast("string"))).alias("url")).distinct()
    named = fitted(ends.select(address(F.col("url")).alias("form"), host.alias("host"), path.alias("path")), rules)
    named = named.where("form is not null and own is not null").select("form", "own").distinct().join(parts.withColumnRenamed("node", "form"), "form", "left").select(F.coalesce("component", "form").alias("component"), "own")
    told = rows.select("component", "own").unionByName(named).where("own is not null").groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    passed = F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow"))
    decided = rows.where("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"), "component")
    open_ = rows.where("own is null").join(told, "component", "left").select("page_id", "host", "path", "rule", passed.alias("verdict"), "component")
    return decided.unionByName(open_)
