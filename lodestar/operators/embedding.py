"""Embedders and the content-keyed embedding cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.session import cut, release

#: Texts of one call of an embedder, and of one round of a cache.
CALL, ROUND = 128, 100_000


class Embedder(Protocol):
    """What turns texts into unit vectors; it is sent to executors, so it must pickle."""

    name: str

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Bag of words by MD5 modulo a width, L2-normalised; needs no model."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashing-{width}"

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float64)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z0-9]+", (text or "").lower()):
                row[int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest(), 16) % self.width] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


#: What models expect before a question, but not before a document.
QUERY_PREFIX = {"BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: "}


class ModelEmbedder:
    """An embedder around encode(texts) of a named model: unit vectors, and the model's prefix before questions."""

    def __init__(self, name: str, encode: Callable[[list[str]], np.ndarray]):
        self.name, self.encode, self.prefix = name, encode, QUERY_PREFIX.get(name, "")

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.asarray(self.encode(texts), dtype=np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([self.prefix + text])[0]


def embed(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """(key, vector) for the distinct texts of rows (key, text), texts of like length together for even batches."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                own = batch.slice(at, CALL)
                vectors = embedder.embed_documents(own.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=["key", "vector"])

    return rows.sortWithinPartitions(F.length("text")).mapInArrow(run, "key string, vector array<float>")


def embed_with_cache(rows: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(rows with vector, new cache entries): only keys that the cache misses are embedded, when either is first read.

    rows: text and any others; cache: key, vector. Both results are lazy: write the new entries before
    reading the rows with them, or use EmbeddingCache, so that nothing is embedded twice.
    """
    keyed = rows.withColumn("key", T.cache_key(F.lit(embedder.name), F.col("text")))
    misses = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = embed(misses, embedder)
    return keyed.join(cache.select("key", "vector").unionByName(fresh), "key", "left").drop("key"), fresh


class EmbeddingCache:
    """Vectors by key of model and text, in a folder of Parquet files that only grows.

    Missing texts are embedded in rounds of about `round_texts`, dealt by their key; each round is
    appended as a whole when it is done. So a run that was broken off goes on with the rounds that are
    left, and no vector is computed again that a finished round has written.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder, round_texts: int = ROUND):
        self.spark, self.folder, self.embedder, self.round_texts = spark, folder, embedder, round_texts
        self._path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """(key, vector), one row a key."""
        if not self._fs.exists(self._path) or not self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/part-*")):
            return self.spark.createDataFrame([], "key string, vector array<float>")
        return self.spark.read.schema("key string, vector array<float>").parquet(self.folder).dropDuplicates(["key"])

    def keyed(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with the key of their text."""
        return rows.withColumn("key", T.cache_key(F.lit(self.embedder.name), F.col(text)))

    def ensure(self, texts: DataFrame, progress: Callable[[int, int], None] = lambda done, total: None) -> int:
        """Embeds the texts (text) that the cache misses, each once, and says how many there were; progress hears of every round."""
        wanted = self.keyed(texts.where("text is not null").select("text"), "text").dropDuplicates(["key"])
        misses = cut(wanted.join(self.read().select("key"), "key", "left_anti"))
        n = misses.count()
        rounds = max(1, -(-n // self.round_texts))
        dealt = misses.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(rounds)))
        for i in range(rounds if n else 0):
            embed(dealt.where(F.col("round") == i).select("key", "text"), self.embedder).write.mode("append").parquet(self.folder)
            progress(i + 1, rounds)
        release(misses)
        return n

    def with_vectors(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with the cached vector of their text; null where the text is null or not cached."""
        return self.keyed(rows, text).join(self.read(), "key", "left").drop("key")
