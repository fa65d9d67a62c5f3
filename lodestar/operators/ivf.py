"""A vector index of cells: a trained coarse quantiser, lists of blocks, probes fitted to a recall.

Cells are those of spherical k-means on a bounded sample (SAMPLE rows a cell); their number follows the
square root of the number of vectors. Every vector is in the list of its cell, as blocks of neighbouring
rows, so the list of a crowded cell is many rows. How many cells a query probes is fitted: exact
neighbours of a few of the vectors show how far down a query's order of cells they lie. On clustered
vectors that is a few cells; on vectors without any structure it is most of them, and the index says so.

Tables are versions of a store: prepared unseen, switched in with everything else, swept later, and
built when they are first asked for if they are not there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import vectors as V
from lodestar.operators.retrieval import dense_top, ranked
from lodestar.operators.store import Snapshot, Store
from lodestar.session import cut, release

#: Rows of the sample for each cell, rounds of k-means, queries that probes are fitted by, recall they are fitted to.
SAMPLE, ROUNDS, FITTED, TARGET, MOST_CELLS = 64, 8, 200, 0.95, 16_384
TABLES = ("lists", "quantiser")


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Quantiser:
    """Unit centroids, one a row, and how many cells a query probes."""

    centroids: np.ndarray
    probes: int

    def nearest(self, matrix: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first."""
        scores = matrix @ self.centroids.T
        n = min(n, scores.shape[1])
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), axis=1, kind="stable"), 1)


def _celled(rows: DataFrame, quantiser: Quantiser, n: int) -> DataFrame:
    """rows (with vector) with cells, the n nearest ones."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["cells array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = quantiser.nearest(V.matrix_of(batch.column("vector")), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


def _trained(sample: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centroids of spherical k-means: each round sums the members of each cell in tasks; centroids alone reach the driver."""
    first = sample.orderBy(F.xxhash64("id", F.lit(seed))).limit(cells).toArrow()
    centroids = _unit(V.matrix_of(first.column("vector").combine_chunks()))
    width = centroids.shape[1]
    for _ in range(ROUNDS):
        now = Quantiser(centroids, 1)

        def run(batches: Iterator[pa.RecordBatch], now: Quantiser = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(now.centroids), np.zeros(len(now.centroids), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    own = V.matrix_of(batch.column("vector"))
                    cell = now.nearest(own, 1)[:, 0]
                    np.add.at(sums, cell, own)
                    counts += np.bincount(cell, minlength=len(counts))
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "total"])

        parts = sample.select("vector").mapInArrow(run, "cell int, n bigint, total array<double>")
        added = parts.groupBy("cell").agg(*[F.sum(F.col("total")[i]).alias(f"x{i}") for i in range(width)]).toArrow()  # a row for each cell
        moved = centroids.copy()
        sums = np.stack([added.column(f"x{i}").to_numpy() for i in range(width)], axis=1)
        moved[added.column("cell").to_numpy()] = _unit(np.round(sums, 9))  # whatever the order of the sums
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def train(vectors: DataFrame, cells: int | None = None, k: int = 10, target: float = TARGET, seed: int = 17) -> Quantiser:
    """A quantiser for vectors (id, vector), fitted so that the probed cells hold the share target of the k nearest.

    Fitted on a sample of at most SAMPLE rows a cell, taken by a hash of the id, and on exact neighbours
    of at most FITTED of them among all rows.
    """
    known = vectors.where("vector is not null").select(F.col("id").cast("bigint").alias("id"), "vector")
    n = known.count()
    if not n:
        return Quantiser(np.zeros((1, 1)), 1)
    cells = min(n, cells or min(MOST_CELLS, max(1, round(math.sqrt(n)))))
    most = SAMPLE * cells
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    sample = cut(known.where(share < F.lit(math.ceil((1 << 20) * min(1.0, 1.2 * most / n)))).orderBy(share, "id").limit(most))
    centroids = _trained(sample, cells, seed)
    asked = sample.orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(FITTED).withColumnRenamed("id", "query_id")
    near = dense_top(known, asked, k + 1).where("query_id <> id")
    whole = Quantiser(centroids, 1)
    order = cut(_celled(asked, whole, cells).select("query_id", F.col("cells").alias("asked_cells")))  # FITTED rows
    own = near.select("query_id", "id").join(_celled(known, whole, 1), "id").join(order, "query_id")
    place = F.array_position("asked_cells", F.element_at("cells", 1)).cast("int")
    counts = {r["place"]: r["n"] for r in own.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell at most
    release(sample, order)
    total, held = sum(counts.values()), 0
    for probes in range(1, cells + 1):
        held += counts.get(probes, 0)
        if held >= target * total:
            break
    return Quantiser(centroids, probes)


def build(vectors: DataFrame, store: Store, quantiser: Quantiser | None = None) -> dict[str, str]:
    """Writes the lists of vectors (id, vector, any facets) and returns versions by table name, not yet published."""
    quantiser = quantiser or train(vectors)
    facets = tuple(c for c in vectors.columns if c not in ("id", "vector"))
    rows = vectors.where("vector is not null").select(F.col("id").cast("bigint").alias("id"), "vector", *facets)
    celled = _celled(rows, quantiser, 1).withColumn("cell", F.element_at("cells", 1)).drop("cells")
    by = ("cell", *facets)
    lists = V.packed(celled.repartitionByRange(*by, "id").sortWithinPartitions(*by, "id"), V.VECTORS, by).withColumn("wide", F.lit(V.wide(vectors)))
    spark = vectors.sparkSession
    told = spark.createDataFrame([(i, c.tolist(), quantiser.probes) for i, c in enumerate(quantiser.centroids)], "cell int, centroid array<double>, probes int")
    return {"lists": store.write("lists", lists), "quantiser": store.write("quantiser", told.coalesce(1))}


def quantiser_of(snapshot: Snapshot, part: str = "") -> Quantiser:
    """The quantiser of a part."""
    rows = snapshot.read("quantiser", part).orderBy("cell").toArrow()
    return Quantiser(V.matrix_of(rows.column("centroid").combine_chunks()), rows.column("probes")[0].as_py())


def probed(snapshot: Snapshot, queries: DataFrame, part: str = "", probes: int | None = None) -> DataFrame:
    """(cell, q_ids, q_matrix): blocks of the queries (query_id, vector) that probe a cell."""
    quantiser = quantiser_of(snapshot, part)
    asked = queries.where("vector is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    spread = _celled(asked, quantiser, probes or quantiser.probes).withColumn("cell", F.explode("cells")).drop("cells")
    return V.query_blocks(spread.repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(64))).sortWithinPartitions("cell", "query_id"), ("cell",))


def search(snapshot: Snapshot, queries: DataFrame, k: int, part: str = "", where: Column | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best k of each query among the vectors in the cells it probes, by their exact products.

    where: a condition on facets, put to the lists before they are read.
    """
    lists = snapshot.read("lists", part)
    is_wide = bool((lists.select("wide").first() or [False])[0])
    lists = lists if where is None else lists.where(where)
    pairs = cut(probed(snapshot, queries, part, probes)).join(lists, "cell")
    return ranked(V.products(pairs, k, V.wide(queries), is_wide), k)


def looked_at(snapshot: Snapshot, queries: DataFrame, part: str = "", probes: int | None = None) -> DataFrame:
    """(query_id, n): how many vectors each query is compared with."""
    quantiser = quantiser_of(snapshot, part)
    sizes = snapshot.read("lists", part).groupBy("cell").agg(F.sum("n").alias("n"))
    asked = _celled(queries.where("vector is not null").select("query_id", "vector"), quantiser, probes or quantiser.probes)
    return asked.select("query_id", F.explode("cells").alias("cell")).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))


def ensured(store: Store, vectors: DataFrame, part: str = "") -> Snapshot:
    """A snapshot that has the part's lists; they are built from vectors and switched in if they are missing."""
    now = store.snapshot()
    return now if now.has("lists", part) else store.publish(build(vectors, store), part, now)
