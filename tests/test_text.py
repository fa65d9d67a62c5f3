"""Text functions on inputs with known results."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("token", "parts"), [("_transport_for_url", ["transport", "for", "url"]), ("beforeRetry", ["before", "retry"]), ("HTTPResponse2Code", ["http", "response2", "code"]), ("__", [])])
def test_split_identifier(spark, token, parts):
    assert one(spark, token, T.split_identifier) == parts


@pytest.mark.parametrize(("question", "expected"), [("Why does `beforeRetry` wait?", '"before" OR "retry" OR "wait"'), ("what is it?", None), ("", None)])
def test_match_expression(spark, question, expected):
    assert one(spark, question, T.match_expression) == expected


@pytest.mark.parametrize(("url", "parts"), [("o/n", ("o", "n")), ("https://h.example/o/n", ("o", "n")), ("https://h.example/o/n.git", ("o", "n")), ("https://h.example/o/n/", ("o", "n")), ("git@h.example:o/n.git", ("o", "n")), ("not a repo", (None, None))])
def test_repo_parts(spark, url, parts):
    row = spark.createDataFrame([(url,)], "x string").select(*T.repo_parts(F.col("x"))).first()
    assert tuple(row) == parts


@pytest.mark.parametrize(("path", "test", "source", "document"), [
    ("src/a.py", False, True, False), ("tests/a.py", True, False, False), ("Test/a.py", True, False, False), ("a/test_x.py", True, False, False), ("pkg/x_test.go", True, False, False),
    ("a/conftest.py", True, False, False), ("ui/a.spec.ts", True, False, False), ("node_modules/a.js", False, False, False), ("a.min.js", False, False, False), ("types/a.d.ts", False, False, False),
    ("docs/guide.md", False, False, True), (".github/x.md", False, False, False), ("data/notes.txt", False, False, False), ("README.txt", False, False, True), ("FooTests.cs", True, False, False), ("poetry.lock", False, False, False),
])
def test_paths(spark, path, test, source, document):
    row = spark.createDataFrame([(path,)], "x string").select(T.is_test_path(F.col("x")), F.coalesce(T.is_source(F.col("x")), F.lit(False)), T.is_document(F.col("x"))).first()
    assert tuple(row) == (test, source, document)


@pytest.mark.parametrize(("text", "yes"), [("Why is it so?", True), ("the reasons", True), ("motivated by", True), ("trade-offs", True), ("whyever reasonable", False)])
def test_rationale(spark, text, yes):
    assert one(spark, text, lambda x: x.rlike(T.RATIONALE)) is yes


@pytest.mark.parametrize(("message", "attempt", "delay"), [("Please retry in 18.4s.", 1, 19.4), ("overloaded", 2, 30.0), ("overloaded", 9, 90.0), ("quota per day used up, retry in 5s", 1, None), ('"retryDelay": "7s"', 1, 8.0)])
def test_retry_delay(spark, message, attempt, delay):
    got = one(spark, message, lambda x: T.retry_delay(x, F.lit(float(attempt))))
    assert got == (pytest.approx(delay) if delay else None)


@pytest.mark.parametrize(("reply", "n", "out"), [("1. YES\n2. no", 2, [True, False]), ("YES", 2, None), ("nothing", 0, [])])
def test_verdicts(spark, reply, n, out):
    assert one(spark, reply, lambda x: T.verdicts(x, F.lit(n))) == out


@pytest.mark.parametrize(("ref", "out"), [("v9.0.0", ["v9.0.0", "release:v9.0.0", "release:v9.0.0", "release:9.0.0"]), ("release:9.0.0", ["release:9.0.0", "release:9.0.0", "release:v9.0.0", "release:9.0.0"]), ("PR#3", ["PR#3"]), ("9.1@120", ["9.1", "release:9.1", "release:v9.1", "release:9.1"])])
def test_release_candidates(spark, ref, out):
    assert one(spark, ref, T.release_candidates) == out


def test_marks_fold(spark):
    assert one(spark, "Für Straße-Noël", T.tokens) == ["fur", "straße", "noel"]
