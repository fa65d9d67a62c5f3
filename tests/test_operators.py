"""Operators on small inputs with known results."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ann, chunking, embedding, evaluation, grounding, ranges, retrieval, store


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_is_that_of_sqlite(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", docs)
    want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH '\"thing\" OR \"eding\" OR \"der\"'").fetchall())
    asked = frame(spark, [(1, "thing"), (1, "eding"), (1, "der")], "query_id bigint, term string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(frame(spark, docs, "id bigint, text string"), asked).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_fusion(spark):
    rows = [(1, i, r) for order in ([1, 2, 3], [3, 1, 4]) for r, i in enumerate(order, 1)]
    best = retrieval.ranked(retrieval.fuse(frame(spark, rows, "query_id bigint, id bigint, rank int")), 1).first()
    assert best["id"] == 1 and best["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_dense_blocks_and_ann(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in retrieval.dense_top(v, q, 10).collect()}
    assert whole == {tuple(r) for r in retrieval.dense_top(v, q, 10, one_pass=7).collect()}
    found = {(r["query_id"], r["id"]) for r in ann.hyperplane_search(v, q, 10).collect()}
    assert len(found & {(r[0], r[1]) for r in whole}) / len(whole) >= 0.9
    assert retrieval.dense_top(v, q.limit(0), 10).count() == 0


def test_history_regroups_by_thread(spark):
    hits = [(1, 1, "a", False, 0.9), (1, 2, "a", True, 0.5), (1, 3, "a", True, 0.6), (1, 4, "b", False, 0.8)]
    out = retrieval.regroup(frame(spark, hits, "query_id bigint, id bigint, thread string, is_passage boolean, score double"), 5).orderBy("rank").collect()
    assert [(r["thread"], r["id"], r["shown_id"]) for r in out] == [("a", 1, 3), ("b", 4, 4)]


def test_windows_cover_and_overlap(spark):
    got = [(r["s"]["start"], r["s"]["end"]) for r in frame(spark, [(1, 201)], "a bigint, b bigint").select(F.explode(chunking.line_windows(F.col("a"), F.col("b"))).alias("s")).collect()]
    assert got[0][0] == 1 and got[-1][1] == 201 and all(x[1] >= y[0] for x, y in zip(got, got[1:], strict=False))


def test_breadcrumbs_ignore_fences(spark):
    text = "# Guide\n```\n# no\n```\n## Timeouts ##\nx\n# Other\n### Deep".split("\n")
    lines = frame(spark, [("a.md", i, t) for i, t in enumerate(text, 1)], "path string, line int, text string")
    trails = [r["trail"] for r in chunking.breadcrumbs(chunking.headings(lines)).orderBy("line").collect()]
    assert trails == ["Guide", "Guide > Timeouts", "Other", "Other > Deep"]


def merge_by_loop(sections, n):
    out, pending = [], None
    for title, start, end, size in sections:
        if pending:
            start, title = pending[1], title or pending[0]
            pending = None
        if size < chunking.SMALL_SECTION and end < n:
            pending = (title, start)
        else:
            out.append((title, start, end))
    return out + ([(pending[0], pending[1], n)] if pending else [])


def test_small_sections_are_carried(spark):
    cases = {"a": [(None, 1, 2, 10), ("x", 3, 5, 10), (None, 6, 9, 200), ("y", 10, 11, 5)], "b": [("q", 1, 4, 500)], "c": [("q", 1, 4, 5), ("r", 5, 6, 5)]}
    rows = [(p, t, s, e, z) for p, xs in cases.items() for t, s, e, z in xs]
    got = chunking.merge_small(frame(spark, rows, "path string, title string, start int, end int, size int")).collect()
    for p, xs in cases.items():
        assert sorted((r["title"], r["start"], r["end"]) for r in got if r["path"] == p) == sorted(merge_by_loop(xs, xs[-1][2]), key=str) or sorted(((r["title"], r["start"], r["end"]) for r in got if r["path"] == p), key=str) == sorted(merge_by_loop(xs, xs[-1][2]), key=str)


def test_passages_are_cut_at_lines(spark):
    body = "head\n\n--- a: " + "word " * 300 + "\n" + "tail " * 200 + "\n\n--- b: end"
    got = chunking.passages(frame(spark, [(1, body), (2, "short")], "id bigint, body string")).orderBy("offset").collect()
    assert [r["id"] for r in got] == [1] * len(got) and len(got) >= 4
    assert all(body[r["offset"] :].lstrip().startswith(r["text"][:20]) and len(r["text"]) <= 1200 for r in got)
    assert got[-1]["text"] == "--- b: end"


def test_passages_of_a_very_long_comment(spark):
    body = "x" * 200_000 + "\n\n--- b: end"
    got = chunking.passages(frame(spark, [(1, body), (2, None), (3, "")], "id bigint, body string")).orderBy("offset").collect()
    assert [r["offset"] for r in got][:3] == [0, 1200, 2400] and got[-1]["text"] == "--- b: end"
    assert sum(len(r["text"]) for r in got[:-1]) == 200_000


def test_percentiles_of_ties_and_nulls(spark):
    rows = [("a", v) for v in (3.0, 1.0, 1.0, 1.0, None, 9.0)] + [("b", None), (None, 2.0)]
    counts = evaluation.value_counts(frame(spark, rows, "g string, v double"), ["g"], "v")
    got = evaluation.percentiles(counts, ["g"], "v", {"p0": (0.0, evaluation.DOWN), "p50": (0.5, evaluation.HALF_EVEN), "p95": (0.95, evaluation.HALF_EVEN), "up": (0.6, evaluation.UP)})
    assert {tuple(r) for r in got.collect()} == {("a", 1.0, 1.0, 9.0, 3.0), (None, 2.0, 2.0, 2.0, 2.0)}


def test_innermost_enclosing(spark):
    defs = frame(spark, [("m", 1, 500, "outer"), ("m", 10, 20, "inner"), ("n", 1, 9, "other")], "path string, start bigint, end bigint, def_id string")
    points = frame(spark, [(1, "m", 15), (2, "m", 300), (3, "m", 600), (4, "n", 9)], "call_id bigint, path string, line bigint")
    assert {r["call_id"]: r["def_id"] for r in ranges.innermost(points, defs, "call_id").collect()} == {1: "inner", 2: "outer", 3: None, 4: "other"}


EVIDENCE = [("s", 0, "src/a.py:10-20", "src/a.py", 10, 20, "code"), ("s", 1, "PR#7", None, None, None, "We *decided* to retry, because “servers” are slow. "), ("s", 2, "commit:0123456789", None, None, None, "fix")]
EV = "session string, seq bigint, ref string, path string, start_line int, end_line int, text string"


@pytest.mark.parametrize(("ref", "out"), [
    ("src/a.py:10-20", "src/a.py:10-20"), ("`src/a.py#L12-L14`", "src/a.py:12-14"), ("src/a.py:12", "src/a.py:12-12"), ("src/a.py:9-12", None), ("src/a.py:18-25", None), ("src/b.py:12", None),
    ("pr#7", "PR#7"), ("[PR#7]", "PR#7"), ("PR#8", None), ("commit:0123456", "commit:0123456789"), ("commit:01234", None), ("commit:0123456789abcdef", "commit:0123456789"),
])
def test_citations(spark, ref, out):
    cites = frame(spark, [("s", 0, ref)], "session string, cite_id bigint, ref string")
    assert grounding.resolve(cites, frame(spark, EVIDENCE, EV)).first()["resolved"] == out


@pytest.mark.parametrize(("quote", "yes"), [('we decided to retry,  because "servers" are slow', True), ("We decided", False), ("we decided to retry because servers are slow", False)])
def test_quotes(spark, quote, yes):
    told = frame(spark, [("s", 0, "PR#7", quote)], "session string, cite_id bigint, ref string, quote string")
    assert grounding.quote_checks(told, frame(spark, EVIDENCE, EV)).first()["supported"] is yes


def test_evidence_merge_is_the_loop(spark):
    from lodestar.streaming.sessions import merge_text

    rows = [("s", i, ref, code, t) for i, (ref, code, t) in enumerate([("a", False, "one"), ("a", False, "one two"), ("a", False, "three"), ("a", False, "two"), ("c", True, "x"), ("c", True, "xy")])]
    want = {}
    for _, _, ref, code, t in rows:
        want[ref] = merge_text(want.get(ref), t, code)
    got = {r["ref"]: r["text"] for r in grounding.merged_evidence(frame(spark, rows, "session string, seq bigint, ref string, is_code boolean, text string")).collect()}
    assert got == want


def test_statistics(spark):
    pairs = [(True, False)] * 9 + [(False, True)] + [(True, True)] * 5
    p = evaluation.mcnemar(frame(spark, pairs, "a boolean, b boolean")).first()
    assert (p["a_only"], p["b_only"]) == (9, 1) and p["p_value"] == pytest.approx(22 / 1024)
    assert evaluation.mcnemar(frame(spark, [(True, True)], "a boolean, b boolean")).first()["p_value"] == 1.0
    assert evaluation.kappa(frame(spark, [(True, True), (False, False)] * 3, "a boolean, b boolean")).first()["kappa"] == 1.0
    assert evaluation.kappa(frame(spark, [(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")).first()["kappa"] == pytest.approx(0.0)
    few = evaluation.bootstrap_ci(frame(spark, [(i, float(i % 2)) for i in range(10)], "i bigint, value double")).first()
    many = evaluation.bootstrap_ci(frame(spark, [(i, float(i % 2)) for i in range(200)], "i bigint, value double")).first()
    assert few["low"] <= 0.5 <= few["high"] and many["high"] - many["low"] < few["high"] - few["low"]
    assert evaluation.bootstrap_ci(frame(spark, [], "i bigint, value double")).first()["n"] == 0


def test_store(spark, tmp_path):
    rows = frame(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, seq int")
    assert {tuple(r) for r in store.first_wins(rows, ["k"], "seq").select("k", "v").collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in store.last_wins(rows, ["k"], "seq").select("k", "v").collect()} == {(1, "b"), (2, "c")}
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    t.activate(t.prepare(rows))
    old = t.current()
    hidden = t.prepare(rows.limit(1))
    assert t.current() == old and t.read().count() == 3
    t.activate(hidden)
    assert t.current() == hidden and t.read().count() == 1 and not (tmp_path / "t" / old).exists()
    with pytest.raises(ValueError):
        t.activate("v-none")


def test_cache_embeds_only_misses(spark):
    e = embedding.HashingEmbedder()
    rows = frame(spark, [("a b",), ("a b",), ("c",)], "text string")
    empty = frame(spark, [], "key string, vector array<float>")
    first, fresh = embedding.embed_with_cache(rows, empty, e)
    assert first.count() == 3 and fresh.count() == 2
    again, none = embedding.embed_with_cache(rows, fresh, e)
    assert none.count() == 0 and again.where("vector is null").count() == 0
