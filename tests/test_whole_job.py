"""Operators and queries do the whole job: nothing is cut before it is looked at."""

import duckdb
import pytest

from lodestar import catalog
from lodestar.operators import grounding, retrieval

SYMBOL = "name string, qualified_name string, path string, start_line int, end_line int"


def test_definitions_beyond_many_namesakes(spark):
    rows = [("f", "a.A.f", "a", i, i) for i in range(60)] + [("f", "long.B.f", "b", i, i) for i in range(12)] + [("g", "long.B.g", "b", 1, 1)]
    symbols = spark.createDataFrame(rows, SYMBOL)
    found = retrieval.find_definitions(symbols, "`B.f(x)`").collect()
    assert [(r["qualified_name"], r["start_line"]) for r in found] == [("long.B.f", i) for i in range(10)]
    assert found[0].asDict().keys() == set(symbols.columns)
    assert {r["qualified_name"] for r in retrieval.find_definitions(symbols, "lib.long.B.f", 100).collect()} == {"long.B.f"}
    namesakes = retrieval.find_definitions(symbols, "Z.f").collect()
    assert [(r["qualified_name"], r["start_line"]) for r in namesakes] == [("a.A.f", i) for i in range(10)]
    assert retrieval.find_definitions(symbols, "h").count() == 0


def gives(spark, data, name, sql, tables):
    """The query gives the rows of sql."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    frame = catalog.queries()[name](spark, data)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    got = frame.select(*names).collect()
    assert plain(map(tuple, got)) == plain(cursor.fetchall())
    return got


@pytest.mark.parametrize("name", ["rrf_fusion", "hybrid_search"])
def test_every_stated_vector_is_fused(spark, data, name):
    got = gives(spark, data, name, catalog.oracle_sql()[name], ["documents", "embeddings"])
    stated = spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert stated > 4 and {r["query_id"] for r in got} == set(range(1, stated + 1))


def test_quotes_of_every_citation(spark, data):
    got = gives(spark, data, "quote_containment", catalog.oracle_sql()["quote_containment"], ["documents"])
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert {(r["cite_id"] % 3, r["supported"]) for r in got} == {(w, yes) for w in range(3) for yes in (True, False)}


@pytest.mark.parametrize("name", ["rrf_fusion", "hybrid_search", "causal_density_topk", "quote_containment", "find_symbol_definitions"])
def test_no_sql_asks_for_less(name):
    for cut in ("IN (0, 20, 40, 60)", "3000", "doc_id % 3 = 1)", "LIMIT 50"):
        assert cut not in catalog.oracle_sql()[name]


def test_first_seen_of_equal_evidence(spark):
    seen = [("s", 4, "a.py:1-30", "a.py", 1, 30), ("s", 2, "A.py:1-30", "a.py", 1, 30), ("t", 1, "a.py:1-30", "a.py", 1, 30), ("s", 3, "PR#1", None, None, None)]
    asked = [("s", 1, "a.py:1-30"), ("s", 2, "a.py:5-9"), ("s", 3, "pr#1"), ("t", 4, "PR#1")]
    evidence = spark.createDataFrame(seen, "session string, seq bigint, ref string, path string, start_line int, end_line int")
    got = {tuple(r)[1:] for r in grounding.resolve(spark.createDataFrame(asked, "session string, cite_id bigint, ref string"), evidence).collect()}
    assert got == {(1, "a.py:1-30", "A.py:1-30", 2, 1), (2, "a.py:5-9", "a.py:5-9", 2, 3), (3, "pr#1", "PR#1", 3, 1), (4, "PR#1", None, None, None)}
