"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.alignment import alignment_statistics
from lodestar.llm.arrow import arrow_map
from lodestar.llm.encoding import byte_encoder
from lodestar.llm.fingerprints import with_neighbours
from lodestar.llm.html_text import extract
from lodestar.llm.licenses import license_scan
from lodestar.llm.near_duplicates import near_duplicates
from lodestar.llm.packing import packed_documents
from lodestar.llm.prefix_trie import coded_turns, node_table, prefix_trie
from lodestar.llm.quality_model import quality_scores
from lodestar.llm.quality_rules import quality_rules
from lodestar.llm.substrings import substring_dedup
from lodestar.llm.urls import Rule, page_links, url_filter
from lodestar.llm.warc import dangling, read_archives, write_archives
from lodestar.session import cut, scratch, table

RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(table(spark, sf_dir, "documents"))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document (null: empty)."""

    def make():
        encoder = byte_encoder(tokenizer)
        names = [str(i) for i in range(encoder.tokenizer.get_vocab_size(with_added_tokens=True))]

        def one(text: str | None) -> tuple:
            ids = encoder.encode(text or "").tolist()
            decoded = encoder.tokenizer.decode(ids, skip_special_tokens=False)
            return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        def step(batch: pa.RecordBatch) -> dict:
            rows = [one(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows, strict=True) if rows else [()] * 3, strict=True))

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", tokenizer)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), str(tokenizer_path("byte_bpe_50k.json")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, RULES, page_links(pages))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), str(tokenizer_path("word_bpe_49k.json")))


#: Conversations of a family of this many share the first turns of its first one; fewer than BORROWED of them.
FAMILY, BORROWED = 5, 9


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the conversations as the contract rebuilds them.

    Conversation c has the first h turns of c - c % FAMILY, then its own after its first h, where h
    is crc32(c) % BORROWED. One without turns stays, with length 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    plan = lengths.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("head"), h.alias("h"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("head"), F.col("n").alias("m")), "head", "left").withColumn("taken", F.least("h", F.coalesce("m", F.lit(0))))
    plan = cut(plan.select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    lent = turns.where(F.col("pos") < BORROWED).withColumnRenamed("conv_id", "head").join(plan.select("conv_id", "head", "h"), "head").where("pos < h").select("conv_id", "pos", "item", "w")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "item", "w")
    return lent.unionByName(own), plan.select("conv_id", "n")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(prefix_trie(*rebuilt(*coded_turns(table(spark, sf_dir, "conversations")))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives lie in the shared folder and are deleted once they are read back."""
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = cut(read_archives(spark, folder, payload=False, mode="failfast").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if not dangling(found).isEmpty():
        raise ValueError("a revisit refers to no response with its digest")
    return found


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents"), str(tokenizer_path("byte_bpe_50k.json")), str(tokenizer_path("piece_bpe_32k.model")))


def queries() -> dict:
    """Name to query, and the pipeline of corpus_pipeline.py."""
    import corpus_pipeline

    own = [op1_fingerprints, op2_bpe_round_trip, op3_near_duplicates, op4_substring_dedup, op5_url_filter, op6_license_scan, op7_quality_rules, op8_quality_classifier, op9_html_text, op10_packing, op11_prefix_trie, op12_warc, op13_token_alignment]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}
