"""Centroid clustering of integer vectors with scalar look-up tables.

Vectors are turned into integers once and stored in blocks, each with the integer values that occur
in every dimension and the place of each component among them. A round tabulates the squared
difference of every dimension, occurring value and centroid; distances are gathers from those
tables and sums. A block has at most ``BLOCK`` vectors, so a table has at most that many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import kept, slices

K, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
# Vectors of a block; places among the occurring values fit 16 bits.
BLOCK = 4096
# Squared distances of 64 components up to this size fit a long.
LARGEST = 1 << 27


def quantised(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component; null unless there are ``dimensions`` finite ones.

    A component whose integer is beyond ``LARGEST`` makes the vector null too, as its squared
    distances need not fit a long.
    """
    scaled = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST)
    good = (F.size(vector) == dimensions) & F.forall(vector, fits)
    return F.when(good, F.transform(vector, scaled))


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def blocks(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``(ids, codes, vals)`` of ``(id, q)``: vectors in blocks, a list of occurring values per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            if not batch.num_rows:
                continue
            found = [np.unique(c, return_inverse=True) for c in _rows(batch.column("q"), dimensions).T]
            codes = np.stack([code for _, code in found]).astype("<u2").tobytes()
            one = [
                pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([codes], pa.binary()),
                pa.array([[v.tolist() for v, _ in found]], pa.list_(pa.list_(pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays(one, ["ids", "codes", "vals"])

    return vectors.mapInArrow(run, "ids array<long>, codes binary, vals array<array<long>>")


@dataclass
class Block:
    ids: pa.Array
    codes: np.ndarray
    values: list[np.ndarray]

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid."""
        total = np.zeros((self.codes.shape[1], len(centroids)), dtype=np.int64)
        for code, value, middle in zip(self.codes, self.values, centroids.T):
            table = (value[:, None] - middle[None, :]) ** 2
            total += table[code]
        return total

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the vectors of each cluster."""
        vectors = np.stack([value[code] for code, value in zip(self.codes, self.values)], axis=1)
        total = np.zeros((k, vectors.shape[1]), dtype=np.int64)
        order = np.argsort(cluster, kind="stable")
        present, first = np.unique(cluster[order], return_index=True)
        total[present] = np.add.reduceat(vectors[order], first, axis=0)
        return total, np.bincount(cluster, minlength=k)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids = batch.column("ids")[row].values
            codes = np.frombuffer(batch.column("codes")[row].as_py(), dtype="<u2").reshape(-1, len(ids))
            values = [np.array(v, dtype=np.int64) for v in batch.column("vals")[row].as_py()]
            yield Block(ids, codes, values)


def means(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty cluster's componentwise floor of its mean; empty ones stay.

    A task sends one row per cluster and dimension, whatever it read.
    """
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for block in _blocks_of(batches):
            more, n = block.sums(block.distances(centroids).argmin(1), k)
            total, count = total + more, count + n
        cells = [np.repeat(np.arange(k), dimensions), np.tile(np.arange(dimensions), k), total.ravel(), np.repeat(count, dimensions)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["cluster", "dim", "total", "n"])

    parts = stored.mapInArrow(run, "cluster long, dim long, total long, n long")
    exact = parts.groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    moved = centroids.copy()
    for r in exact.where("n > 0").collect():  # k * dimensions rows
        moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return moved


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)``: the nearest centroid, ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            far = block.distances(centroids)
            cluster = far.argmin(1)
            out = [block.ids, pa.array(cluster, pa.int32()), pa.array(far[np.arange(len(far)), cluster])]
            yield pa.RecordBatch.from_arrays(out, ["id", "cluster", "distance"])

    return stored.mapInArrow(run, "id long, cluster int, distance long")


@dataclass
class Clustering:
    """``assignment`` is ``(id, cluster, distance)``, ``centroids`` an integer matrix, a row per cluster."""

    assignment: DataFrame
    centroids: np.ndarray

    def summary(self) -> DataFrame:
        """``(cluster, cluster_inertia, inertia, centroid_sha256)``, a row per non-empty cluster."""
        found = self.assignment.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows at most
        total = sum(r["d"] for r in found)
        text = lambda c: ",".join(map(str, self.centroids[c].tolist()))
        rows = [(r["cluster"], r["d"], total, hashlib.sha256(text(r["cluster"]).encode()).hexdigest()) for r in found]
        return self.assignment.sparkSession.createDataFrame(
            rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
        )


def cluster(
    df: DataFrame,
    ids: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    salt: str = "2:",
) -> Clustering:
    """Cluster the vectors of ``df`` around ``k`` centroids in ``rounds`` rounds.

    The first centroids are the vectors with the smallest sha256 of ``salt`` and id, in that order
    (ties by id, then vector; null ids last). A vector goes to the nearest centroid by squared
    distance, ties to the smaller number.

    Vectors that are null, of another length, or with a null, non-finite or too large component
    (``quantised``) take no part and have no row. Rows that repeat an id or a vector are rows of
    their own; a null id is kept as null. Fewer vectors than ``k`` make as many centroids; an empty
    table gives an empty assignment. Only integers leave the scan; other columns do not matter.
    """
    rows = df.select(F.col(ids).cast("long").alias("id"), quantised(F.col(vector), dimensions, scale).alias("q"))
    stored = kept(blocks(rows.where("q IS NOT NULL"), dimensions), "blocks")
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.where("q IS NOT NULL").orderBy(name.asc_nulls_last(), "id", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    if not len(centroids):
        empty = df.sparkSession.createDataFrame([], "id long, cluster int, distance long")
        return Clustering(empty, centroids)
    for _ in range(rounds):
        centroids = means(stored, centroids)
    return Clustering(kept(assigned(stored, centroids), "assigned"), centroids)
