"""Approximate nearest neighbours: random-hyperplane buckets and exact re-ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.retrieval import ranked

TABLES, BITS, PROBES = 16, 6, 3


def _codes(matrix: np.ndarray, tables: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes of each row in each table; with probes, also those one sure flip away."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, matrix.shape[1]))
    sides = np.einsum("tbd,nd->ntb", planes, matrix)
    powers = 1 << np.arange(bits)
    base = ((sides > 0) * powers).sum(axis=2)
    near = np.argsort(np.abs(sides), axis=2)[:, :, : max(0, probes)]
    out = [base] + [base ^ powers[near[:, :, p]] for p in range(near.shape[2])]
    return np.stack(out, axis=2) + (np.arange(tables) << bits)[None, :, None]


def _bucketed(vectors: DataFrame, name: str, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                matrix = np.array(batch.column("vector").to_pylist(), dtype=np.float64)
                codes = _codes(matrix, tables, bits, probes, seed).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("vector"), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[name, "vector", "codes"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.where("vector is not null").select(F.col(name).cast("bigint").alias(name), "vector").mapInArrow(run, f"{name} bigint, vector {kind}, codes array<int>")


def hyperplane_search(vectors: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = 17) -> DataFrame:
    """(query_id, id, score, rank): the best k among the vectors that share a bucket with a query.

    Every vector is indexed; a query also probes the buckets across its nearest planes. Candidates
    are re-ranked by their exact dot product.
    """
    index = _bucketed(vectors.select("id", "vector"), "id", tables, bits, 0, seed).select("id", "vector", F.explode("codes").alias("code"))
    probe = _bucketed(queries, "query_id", tables, bits, probes, seed).select("query_id", F.col("vector").alias("q"), F.explode("codes").alias("code"))
    dot = F.aggregate(F.zip_with("q", "vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    found = probe.join(index, "code").select("query_id", "id", F.round(dot, 6).alias("score")).distinct()
    return ranked(found, k)
