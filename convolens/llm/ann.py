"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``listed`` nearest pivots. For each pivot an inverted
list holds the vectors that have it in their order, with its rank there. A query adds up, over the
lists of its own nearest pivots, what each meeting saves of the footrule distance between the two
orders (a pivot missing in an order counts as ranked last). The vectors of smallest footrule are
ranked again by exact distance.

The lists are partitioned by vector: each shard of about ``SHARD`` vectors has lists of its own, so
no list of a popular pivot is in one place, and every shard is of bounded size. Queries meet
shards in blocks and only the nearest few of each meeting are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import kept
from convolens.llm.vectors import matrix, usable

PIVOTS = 128  # the sample the index is fitted on: this many vectors, whatever the table's size
LISTED = 64
SHARD = 2048
QUERY_BLOCK = 1024
# The footrule passes on this share of a shard's vectors to the exact distance, and no fewer than so many.
RERANKED, LEAST_RERANKED = 0.25, 256

_SHARDS = "shard int, ids binary, vectors binary, starts binary, members binary, ranks binary"


@dataclass
class PermutationIndex:
    pivots: np.ndarray
    shards: DataFrame
    n_shards: int


def _orders(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the first pivot."""
    far = (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :listed]


def _shard(group: pa.Table, pivots: np.ndarray, listed: int) -> pa.Table:
    """One shard: vectors in the order of their ids, and the inverted lists of all pivots."""
    group = group.sort_by("id")
    x = matrix(group.column("v"))
    orders = _orders(x, pivots, listed)
    flat = orders.ravel()
    sort = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[sort], np.arange(len(pivots) + 1))
    parts = {
        "ids": group.column("id").to_numpy().astype(np.int64),
        "vectors": x,
        "starts": starts.astype(np.int32),
        "members": (sort // orders.shape[1]).astype(np.int32),
        "ranks": (sort % orders.shape[1]).astype(np.int32),
    }
    shard = group.column("shard").slice(0, 1)
    return pa.table({"shard": shard} | {k: pa.array([a.tobytes()], pa.binary()) for k, a in parts.items()})


def build(
    df: DataFrame,
    ids: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    listed: int = LISTED,
    copies: int | None = None,
) -> PermutationIndex:
    """Index all vectors of a table that take part (not null, zero or partly null or not finite).

    ``copies`` limits how many rows of one identical vector are indexed, smallest ids first; give
    ``k + 1`` where at most ``k`` neighbours are asked for, as more copies cannot be answers. All
    vectors must have one length.
    """
    rows = usable(df, ids, vector).withColumn("v", F.col("v").cast("array<double>"))
    if copies is not None:
        rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= copies).drop("_rank")
    rows = kept(rows, "vectors")
    n, shortest, longest = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if shortest != longest:
        raise ValueError(f"vectors of lengths {shortest} to {longest} in one table")
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    points = np.array([r[0] for r in chosen], dtype=np.float64).reshape(len(chosen), longest or 0)
    n_shards = max(1, ceil(n / SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).cast("int"))
    shards = dealt.groupBy("shard").applyInArrow(lambda t: _shard(t, points, listed), _SHARDS)
    return PermutationIndex(points, kept(shards, "index"), n_shards)


def _meet(shards: pa.Table, queries: pa.Table, pivots, listed: int, k: int, share: float) -> pa.Table:
    """The nearest ``k`` of one shard for each query of one block."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if shards.num_rows and queries.num_rows:
        part = {c: shards.column(c)[0].as_py() for c in shards.column_names if c not in ("shard", "block")}
        ids = np.frombuffer(part["ids"], np.int64)
        x = np.frombuffer(part["vectors"], np.float64).reshape(len(ids), -1)
        starts, members, ranks = (np.frombuffer(part[c], np.int32) for c in ("starts", "members", "ranks"))
        asked, names = matrix(queries.column("v")), queries.column("id").to_pylist()
        passed = min(len(ids), max(k + 1, LEAST_RERANKED, ceil(share * len(ids))))
        width = min(listed, len(pivots))
        for q, name, order in zip(asked, names, _orders(asked, pivots, listed)):
            saved = np.zeros(len(ids), dtype=np.int32)
            for rank, pivot in enumerate(order):
                at = slice(starts[pivot], starts[pivot + 1])
                saved[members[at]] += width - np.maximum(ranks[at], rank)
            best = np.argsort(-saved, kind="stable")[:passed]
            best = best[ids[best] != name]
            far = x[best] - q
            far = np.sqrt((far * far).sum(1))
            near = np.lexsort((ids[best], far))[:k]
            out["query_id"] += [name] * len(near)
            out["vec_id"] += ids[best][near].tolist()
            out["score"] += far[near].tolist()
    return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def search(index: PermutationIndex, queries: DataFrame, k: int = 10, listed: int = LISTED, share: float = RERANKED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` nearest of each query ``(id, v)``.

    Nearest first by Euclidean distance, ties to the smaller id; a query does not find the row of
    its own id. At least ``k + 1`` vectors of every shard are measured, so a small table gives
    all there are.
    """
    asked = kept(queries.select("id", F.col("v").cast("array<double>").alias("v")), "queries")
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))
    n, pivots = index.n_shards, index.pivots
    met = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"))
    parts = index.shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = (
        parts.groupBy("shard", "block")
        .cogroup(met.groupBy("shard", "block"))
        .applyInArrow(
            lambda s, q: _meet(s, q, pivots, listed, k, share), "query_id long, vec_id long, score double"
        )
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(
    df: DataFrame, every: int, ids: str = "vec_id", vector: str = "embedding", k: int = 10, **options
) -> DataFrame:
    """Neighbours of every row whose id is divisible by ``every``, among all rows of the table."""
    index = build(df, ids, vector, copies=k + 1, **options)
    queries = usable(df, ids, vector).where(F.col("id") % every == 0)
    return search(index, queries, k)

