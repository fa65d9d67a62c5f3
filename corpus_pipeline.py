"""The corpus pipeline: rules, classifier, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents (doc_id, text, lang, source, n_chars); the last returns the packed
pieces. Counts, references and the model of a stage come from its own input.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.near_duplicates import near_duplicates
from lodestar.llm.packing import packed_documents
from lodestar.llm.quality_model import quality_scores
from lodestar.llm.quality_rules import quality_rules
from lodestar.llm.substrings import substring_dedup
from lodestar.session import BROADCAST_ROWS, cut, scratch, table

#: SQL cannot express the pipeline (trees, tokenizer, genetic packing); tests hold it against brute force.
ORACLE_SQL = None


#: Columns that the stages work on. Others travel under names of their own, so none can clash.
WORKED_ON = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in WORKED_ON else f"given_{i}" for i, c in enumerate(docs.columns)])


def _chosen(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in verdicts (kept_id), which holds each kept doc_id once."""
    verdicts = cut(verdicts)
    if verdicts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts["kept_id"]), "left_semi")


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or short text fails the rules and goes; very long texts are judged whole; repeated
    rows are judged alike, each for itself; a null lang or doc_id changes nothing about the row.
    Extra columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    own = _apart(docs)
    return quality_rules(own, keep_text=True).where("kept").select(*own.columns).toDF(*docs.columns)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored as texts without words, very long ones whole; repeated rows
    score alike and stay or go together. Without labels of both kinds all rows have one score.
    Extra columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    own = _apart(docs)
    return quality_scores(own, table(spark, sf_dir, "labels"), keep_text=True).where("predicted = 1").select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Texts without words and rows with a null doc_id are in no group and stay; very long texts are
    compared whole. Rows that repeat a doc_id are one document: they stay or go together. Extra
    columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    own = _apart(docs)
    return _chosen(own, near_duplicates(own).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that also start earlier; n_chars follows the text.

    All rows stay. Null, empty and short texts, and rows with a null doc_id, are left as they are;
    very long texts are searched whole. Rows that repeat doc_id and text are one document and lose
    nothing to each other; rows of one doc_id with other texts are documents of their own. Extra
    columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    own = _apart(docs)
    out = substring_dedup(own, keep_text=True)
    fields = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return out.select(*[fields.get(c, F.col(c)) for c in own.columns]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end token alone; a very long one is cut into full pieces
    and a last one. Rows that repeat a doc_id are packed each for itself; a null doc_id stays null.
    Extra columns are ignored. An empty table gives an empty one.
    """
    return packed_documents(docs, str(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each stage's output is written and read again.

    What is written lies in the shared folder, and a stage's input is deleted once its output is
    written. Nulls, empty and long texts, repeats and empty tables are as the stages state.
    """
    import uuid

    docs, folder, before = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _removed(spark, before)
        docs, before = spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
