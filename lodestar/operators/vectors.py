"""Blocks of vectors, and the products of query blocks with vector blocks.

A block is a row: ids and a matrix as bytes. Blocks are packed within tasks, from neighbouring rows,
so packing shuffles nothing; pairs of blocks are multiplied in tasks, and a task keeps the best k of
each query that it met, so only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import BROADCAST_ROWS, cut

#: Vectors of a block, queries of a block, queries that one pass over unpacked vectors takes at most.
VECTORS, QUERIES, ONE_PASS = 2_048, 512, 4_096
#: Best results that a task holds before it gives them away, and digits that scores are rounded to.
HELD, DIGITS = 4_000_000, 6


def matrix_of(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, ids, matrix) of rows (id, vector, by): blocks of at most size neighbouring rows of equal by.

    Vectors are kept as 32-bit floats if they are such, else as 64-bit ones. Null vectors are left out.
    """
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    width = np.dtype("<f4" if kind == "float" else "<f8")
    own = rows.where("vector is not null").select(*by, F.col("id").cast("bigint").alias("id"), "vector")
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by), "n int, ids binary, matrix binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        types: list[pa.DataType] = []

        def block() -> pa.RecordBatch:
            n = sum(map(len, ids))
            columns = [pa.array([v], t) for v, t in zip(key, types, strict=True)]
            columns += [pa.array([n], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate(parts).astype(width).tobytes()], pa.binary())]
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*by, "n", "ids", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            numbers, matrix = batch.column("id").to_numpy(), matrix_of(batch.column("vector"))
            at = 0
            while at < len(keys):
                if ids and (keys[at] != key or sum(map(len, ids)) >= size):
                    yield block()
                key, stop = keys[at], min(len(keys), at + size - sum(map(len, ids)))
                stop = next((i for i in range(at, stop) if keys[i] != key), stop) if by else stop
                ids.append(numbers[at:stop])
                parts.append(matrix[at:stop])
                at = stop
        if ids:
            yield block()

    return own.mapInArrow(run, schema)


class Best:
    """The best k ids of each query that was met; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}
        self.size = 0

    def add(self, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query, a column for each id. query_ids is a block, always the same for its first id."""
        key, (n, width) = query_ids.tobytes(), scores.shape
        old_ids, old_scores = self.held.get(key, (np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0))))
        self.size -= old_ids.size
        least = np.full(n, -np.inf)
        if old_ids.shape[1] == self.k:
            least = old_scores[:, -1]
        elif width > self.k:
            least = np.partition(scores, width - self.k, axis=1)[:, width - self.k]
        # Only what may be among the best is rounded and sorted; rounding moves a score by half a digit at most.
        row, column = np.nonzero(~(scores < (least - 10.0**-DIGITS)[:, None]))
        rows = np.concatenate([np.repeat(np.arange(n), old_ids.shape[1]), row])
        names = np.concatenate([old_ids.ravel(), ids[column]])
        values = np.concatenate([old_scores.ravel(), np.round(scores[row, column], DIGITS)])
        order = np.lexsort((names, -values, rows))
        place = np.arange(len(rows)) - np.repeat(np.searchsorted(rows[order], np.arange(n)), np.bincount(rows, minlength=n))
        best = order[place < self.k]
        self.held[key] = names[best].reshape(n, -1), values[best].reshape(n, -1)
        self.size += len(best)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) of all that is held, which is then forgotten."""
        for key, (ids, scores) in self.held.items():
            names = np.repeat(np.frombuffer(key, dtype=np.int64), ids.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "id", "score"])
        self.held, self.size = {}, 0


RESULT = "query_id bigint, id bigint, score double"


def products(pairs: DataFrame, k: int, q_wide: bool, v_wide: bool) -> DataFrame:
    """(query_id, id, score): candidates for the best k of each query, from pairs (q_ids, q_matrix, ids, matrix) of blocks."""
    q_type, v_type = (np.dtype("<f8" if wide else "<f4") for wide in (q_wide, v_wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for q_ids, q_matrix, ids, matrix in zip(*(batch.column(c) for c in ("q_ids", "q_matrix", "ids", "matrix")), strict=True):
                names, numbers = (np.frombuffer(x.as_py(), dtype="<i8") for x in (q_ids, ids))
                left = np.frombuffer(q_matrix.as_py(), dtype=q_type).astype(np.float64).reshape(len(names), -1)
                right = np.frombuffer(matrix.as_py(), dtype=v_type).astype(np.float64).reshape(len(numbers), -1)
                best.add(names, numbers, left @ right.T)
                if best.size > HELD:
                    yield from best.rows()
        yield from best.rows()

    return pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(run, RESULT)


def wide(rows: DataFrame) -> bool:
    """Whether the vectors of rows are 64-bit floats."""
    return rows.schema["vector"].dataType.elementType.simpleString() != "float"


def query_blocks(queries: DataFrame, by: tuple[str, ...] = (), size: int = QUERIES) -> DataFrame:
    """(by, q_ids, q_matrix) of queries (query_id, vector, by)."""
    rows = packed(queries.withColumnRenamed("query_id", "id"), size, by)
    return rows.select(*by, F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))


def in_one_pass(vectors: DataFrame, names: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """Candidates for the best k of a few queries, whose matrix goes along with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            if batch.num_rows:
                numbers, own = batch.column("id").to_numpy(), matrix_of(batch.column("vector")).T
                for first in range(0, len(numbers), VECTORS):
                    part = slice(first, first + VECTORS)
                    for at in range(0, len(names), QUERIES):
                        best.add(names[at : at + QUERIES], numbers[part], matrix[at : at + QUERIES] @ own[:, part])
        yield from best.rows()

    return vectors.where("vector is not null").select(F.col("id").cast("bigint").alias("id"), "vector").mapInArrow(run, RESULT)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, one_pass: int = ONE_PASS) -> DataFrame:
    """(query_id, id, score): the best k of each query are among these, at most k a task and query.

    vectors: id, vector; queries: query_id, vector. Vectors are dealt over all cores, as a file of them
    is small for the work it makes. At most one_pass queries go along with the tasks; more become
    blocks, each multiplied with each block of vectors.
    """
    vectors = vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "id")
    asked = queries.where("vector is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    first = asked.limit(one_pass + 1).toArrow()
    if first.num_rows <= one_pass:
        return in_one_pass(vectors, first.column("query_id").to_numpy().astype(np.int64), matrix_of(first.column("vector").combine_chunks()), k)
    blocks = cut(query_blocks(asked))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    return products(packed(vectors, VECTORS).crossJoin(blocks), k, wide(asked), wide(vectors))
