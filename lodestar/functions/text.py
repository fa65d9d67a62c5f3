"""Text expressions: tokens, identifiers, normal forms and reference parsing as Spark columns."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question's search terms leave out.
STOPWORDS = (
    "a an and are as at be but by can could did do does doing for from had has have how i if in into is it "
    "its me my not of on or our should so that the their them then there these they this to too was we were "
    "what when where which who whom why will with would you your about exactly specific specifically "
    "explain describe list name"
).split()
#: Latin letters with marks and the letters that they are searched as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
#: The words that ask for a rationale.
RATIONALE = r"(?i)\bwhy\b|\breasons?\b|\brationale\b|\bmotivat|\btrade-?offs?\b"


def tokens(text: Column) -> Column:
    """Full-text tokens: lower case, marks folded, parted at all but letters, digits and private use."""
    return F.filter(F.split(F.translate(F.lower(text), MARKED, PLAIN), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def identifiers(text: Column) -> Column:
    """ASCII identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))


def split_identifier(token: Column) -> Column:
    """Lower-cased parts of an identifier at underscores and camel-case humps."""
    return F.filter(F.transform(F.split(token, f"_|{CAMEL}"), F.lower), lambda x: x != "")


def search_terms(text: Column) -> Column:
    """The parts of all identifiers of a text, in order."""
    return F.flatten(F.transform(identifiers(text), split_identifier))


def search_body(title: Column, symbol: Column, path: Column, text: Column, extra: Column | None = None) -> Column:
    """What full text search indexes of a chunk: title, symbol and path, the text, the parts of its
    camel-case identifiers, and extra terms (an array), parted by spaces. Nulls and empty parts are left out."""
    kept = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" ", kept(title), kept(symbol), kept(path))
    humps = F.filter(identifiers(F.concat_ws(" ", head, text)), lambda x: x.rlike(CAMEL))
    parts = F.array_join(F.flatten(F.transform(humps, split_identifier)), " ")
    return F.concat_ws(" ", head, text, parts, F.coalesce(extra, F.array().cast("array<string>")) if extra is not None else F.lit(None).cast("string"))


def query_terms(text: Column) -> Column:
    """Distinct search terms of a question without stopwords and single letters; null if none are left."""
    kept = F.filter(F.array_distinct(search_terms(text)), lambda x: ~x.isin(STOPWORDS) & (F.length(x) > 1))
    return F.when(F.size(kept) > 0, kept)


def match_expression(text: Column) -> Column:
    """The full-text OR expression of a question; null if it has no terms."""
    return F.array_join(F.transform(query_terms(text), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")


def without_comments(text: Column) -> Column:
    """Text without HTML comments and outer blanks; null gives an empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<!--.*?-->", ""), r"^\s+|\s+$", "")


def quote_form(text: Column) -> Column:
    """What quotes are compared by: lower case, no emphasis marks, straight quotes, single spaces."""
    bare = F.translate(F.lower(text), "’“”`*_>#", "'\"\"")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .]+|[ .]+$", "")


def normal_ref(ref: Column) -> Column:
    """A reference without formatting; anchors like #L3-L9 become :3-9."""
    bare = F.regexp_replace(F.regexp_replace(ref, r"^\s+|\s+$", ""), r"^[`\[\]() ]+|[`\[\]() ]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"#L(\d+)-L(\d+)", ":$1-$2"), r"#L(\d+)", ":$1")


#: Fixed value: a reference to a path and lines.
RANGE = r"^(.+?)(?::|#L)(\d+)(?:-L?(\d+))?$"


def ref_range(ref: Column) -> tuple[Column, Column, Column]:
    """Path, first and last line of a line reference; null where it is none."""
    start = F.regexp_extract(ref, RANGE, 2).try_cast("bigint")
    return F.nullif(F.regexp_extract(ref, RANGE, 1), F.lit("")), start, F.coalesce(F.regexp_extract(ref, RANGE, 3).try_cast("bigint"), start)


def linked_numbers(text: Column, threads: bool = True) -> Column:
    """Distinct ascending numbers of #n links: as threads write them, or as commit messages do."""
    before = r"(?:^|[^\w/])" if threads else r"(?:^|[(\s])"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(before + r"#(\d+)\b"), F.lit(1)), lambda x: x.cast("bigint"))))


def release_candidates(ref: Column) -> Column:
    """Spellings under which a loosely named release may be indexed, best first."""
    bare = F.element_at(F.split(normal_ref(ref), "@"), 1)
    marked = F.lower(bare).startswith("release:")
    tag = F.when(marked, F.substring(bare, 9, 1_000_000)).otherwise(bare)
    plain = F.regexp_replace(tag, "^v+", "")
    known = F.array(bare, F.concat(F.lit("release:"), tag), F.concat(F.lit("release:v"), plain), F.concat(F.lit("release:"), plain))
    return F.when(marked | bare.rlike(r"^v?\d+(\.\d+)+"), known).otherwise(F.array(bare))


def is_history(ref: Column) -> Column:
    """Whether a reference is to a thread, release or commit."""
    return ref.rlike(r"(?i)^(PR#|issue#|discussion#|release:|commit:)")


def number_of(ref: Column) -> Column:
    """The number at the end of a thread's reference; null if it has none."""
    return F.regexp_extract(ref, r"#(\d+)$", 1).try_cast("bigint")


def source_url(owner: Column, name: Column, commit: Column, kind: Column, ref: Column) -> Column:
    """The web address of a piece of evidence: lines of a file at a commit, a commit, a release, a thread."""
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)
    path, start, end = ref_range(ref)
    tail = F.regexp_extract(ref, r"^[^:]*:(.*)$", 1)
    section = F.when(kind == "pr", "/pull/").when(kind == "issue", "/issues/").when(kind == "discussion", "/discussions/")
    return (
        F.when(kind.isin("code", "doc"), F.concat(base, F.lit("/blob/"), commit, F.lit("/"), path, F.lit("#L"), start, F.lit("-L"), end))
        .when(kind == "commit", F.concat(base, F.lit("/commit/"), tail))
        .when(kind == "release", F.concat(base, F.lit("/releases/tag/"), tail))
        .otherwise(F.concat(base, section, number_of(ref)))
    )


def snippet(text: Column, first_line: Column, ref: Column, most: int = 2000) -> Column:
    """The lines of an evidence text, which begins at first_line, that a resolved line reference names; the whole text for others."""
    _, start, end = ref_range(ref)
    own = F.array_join(F.slice(F.split(text, "\n"), (F.greatest(start - first_line, F.lit(0)) + 1).cast("int"), (end - start + 1).cast("int")), "\n")
    return F.substring(F.when(first_line.isNotNull() & start.isNotNull(), own).otherwise(text), 1, most)


def markers(answer: Column) -> Column:
    """Numbers of the [n] markers of an answer."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))


def verdicts(reply: Column, expected: Column) -> Column:
    """YES and NO of a judge's reply as booleans; null unless there are as many as expected."""
    found = F.regexp_extract_all(F.upper(reply), F.lit(r"\b(YES|NO)\b"), F.lit(1))
    return F.when(F.size(found) == expected, F.transform(found, lambda x: x == "YES"))


def repo_parts(url: Column) -> tuple[Column, Column]:
    """Owner and name of a repository address (owner/name, https or ssh form); null if it is none."""
    form = r"^(?:https?://[^/\s]+/|git@[^:\s]+:)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    hit = F.trim(url).rlike(form)
    return F.when(hit, F.regexp_extract(F.trim(url), form, 1)), F.when(hit, F.regexp_extract(F.trim(url), form, 2))


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as a whole-string regular expression; * crosses slashes."""
    return fnmatch.translate(pattern).replace("\\Z", "\\z")


def retry_delay(message: Column, attempt: Column) -> Column:
    """Seconds to wait: what the message asks for and one more, else 15 an attempt up to 90; null for a daily quota."""
    asked = F.regexp_extract(message, r"(?i)(?:retry in |retryDelay\W+)(\d+(?:\.\d+)?)s", 1)
    wait = F.when(asked != "", F.nullif(asked, F.lit("")).cast("double") + 1).otherwise(F.least(15.0 * attempt, F.lit(90.0)))
    return F.when(~message.rlike("(?i)per ?day|daily"), wait)


def cache_key(model: Column, text: Column) -> Column:
    """SHA-256 of model, NUL and text."""
    return F.sha2(F.concat(model, F.lit("\0"), text), 256)


# ---- paths --------------------------------------------------------------------------------------
#: Directories and names that mark tests or are left out, and languages by extension.
TEST_DIRS = ("test", "tests", "__tests__", "testing", "spec", "specs")
TEST_NAMES = r"(^test_)|(_test\.(py|go|rs)|_spec\.rb|tests?\.(java|cs)|test\.(kt|php))$|^conftest\.py$|\.test\.|\.spec\."
SKIPPED_DIRS = ("node_modules", "vendor", "dist", "build", "site-packages", ".github", "third_party")
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java",
    "kt": "kotlin", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "scala": "scala", "sh": "bash", "sql": "sql", "lua": "lua", "r": "r", "pl": "perl", "ex": "elixir", "hs": "haskell",
}


def _names(path: Column) -> tuple[Column, Column]:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)


def is_test_path(path: Column) -> Column:
    """Whether a path is a test's by a directory (in any case) or its name."""
    dirs, name = _names(path)
    return F.exists(dirs, lambda x: F.lower(x).isin(*TEST_DIRS)) | F.lower(name).rlike(TEST_NAMES)


def language_of(path: Column) -> Column:
    """Language of a source path; null for minified, declaration and lock files and what is no code."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    _, name = _names(path)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(~name.rlike(r"\.min\.js$|\.d\.ts$|\.lock$"), F.try_element_at(known, extension))


def is_source(path: Column) -> Column:
    """Whether a path is indexed as code."""
    return language_of(path).isNotNull() & ~F.exists(F.split(path, "/"), lambda x: x.isin(*SKIPPED_DIRS)) & ~is_test_path(path)


def is_document(path: Column) -> Column:
    """Whether a path is indexed as a document; of text files only the usual top-level ones are."""
    _, name = _names(path)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    stem = F.upper(F.regexp_replace(name, r"\.[^.]+$", ""))
    prose = (suffix == ".txt") & stem.isin("README", "CHANGELOG", "CHANGES", "HISTORY")
    other = suffix.isin(".md", ".mdx", ".rst") & ~F.exists(F.split(path, "/"), lambda x: x.isin("node_modules", ".github"))
    return (prose | other) & ~is_test_path(path)
