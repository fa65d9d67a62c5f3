"""The pipeline's stages, each against plain versions of its operator, and the registered queries."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lodestar.llm import oracles
from lodestar.llm.quality_model import quality_scores
from lodestar.llm.quality_rules import quality_rules
from tests.llm import brute
from tests.llm.test_documents import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, data).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages(spark, data, stages):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert all(s.columns == COLUMNS for s in stages[:4])
    kept = {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    assert set(texts(stages[0])) == kept and 0 < len(kept) < docs.count()
    good = {r["doc_id"] for r in quality_scores(stages[0], spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    assert set(texts(stages[1])) == good
    near = brute.near(texts(stages[1]), 80)
    assert set(texts(stages[2])) == {d for d, (_, c) in near.items() if c == d}
    repeats = brute.substring(texts(stages[2]))
    got = texts(stages[3])
    assert set(got) == set(repeats)
    before = texts(stages[2])
    for d, (n, removed, _) in repeats.items():
        assert len(brute.WORD.findall(got[d])) == n - removed
        assert removed or got[d] == before[d]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect() if repeats[r["doc_id"]][1])
    check_packing(stages[4].collect(), got, 4096)


def test_run_is_the_stages(spark, data, stages):
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, data).collect()) == key(stages[4].collect())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    cursor = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    frame = __spark_entry__.queries()[name](spark, data).select(*names)
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
