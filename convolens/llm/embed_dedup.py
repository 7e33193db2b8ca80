"""Embedding near-duplicates by sorted projection passes.

A pass gives every distinct vector a key, the concatenated signs of its products with random
directions, and sorts by it over the cluster. In this order lie blocks of ``WINDOW`` vectors; each is
compared with itself and the next, so every vector meets at least ``WINDOW`` neighbours on either
side. Vectors that share the first ``bits`` signs all meet: where such a run spans more blocks, its
parts of all these blocks meet as well. Compared pairs are verified in double precision.

Two vectors at the threshold agree in one sign with probability ``1 - acos(threshold) / pi``, so they
meet in one pass with at least that to the power of ``bits``, whatever the other vectors are. ``bits``
grows with the logarithm of the number of vectors, and there are as many passes as leave such a pair
unmet with probability ``MISS`` at most; closer pairs are far less likely to be missed.

The verified pairs of all passes are united into components. Links are counted exactly inside each:
its vectors are dealt into tiles, and every two tiles meet. Tasks report no pairs, only counts and one
member of each vector's group within the task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import kept, map_batches, numbered
from convolens.llm.components import components
from convolens.llm.vectors import matrix, takes_part, usable
from convolens.runtime import join_small

THRESHOLD = 0.95
# Vectors of a block of the sorted order.
WINDOW = 2048
# Probability at most that all passes miss a pair at the threshold.
MISS = 1e-6
# Signs of a key: enough that the order goes on within runs of equal prefixes.
SIGNS = 48
SEED = 6
# Vectors of a tile at most, on average; and tiles that smaller components are dealt over, so that cores share the work.
TILE = 8192
LEAST_TILES = 16
# A tile of a smaller component has this many vectors at least.
PAIRED = 16
# Rows of one product of matrices.
BLOCK = 1024


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, columns, near)``: which vectors of ``x`` and ``y`` are links, where there are any."""
    wide = [m / np.sqrt((m * m).sum(1, keepdims=True)) for m in (x, y)]
    left, right = (m.astype(np.float32) for m in wide)
    # More than rounding can take from a product of unit vectors in single precision.
    least = threshold - 1e-4 - 1.2e-7 * x.shape[1]
    may = np.concatenate([left[i : i + BLOCK] @ right.T >= least for i in range(0, len(left), BLOCK)])
    rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    near = may[np.ix_(rows, columns)]
    y, far = y[columns], np.sqrt((y[columns] * y[columns]).sum(1))
    for i in range(0, len(rows), BLOCK):
        part = x[rows[i : i + BLOCK]]
        near[i : i + BLOCK] = (part @ y.T) / (np.sqrt((part * part).sum(1))[:, None] * far) >= threshold
    return rows, columns, near


def _spanned(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix the first row of its group, -1 without links."""
    left, right = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for first in np.flatnonzero(near.any(1)):
        if left[first] >= 0:
            continue
        front, left[first] = np.array([first]), first
        while len(front):
            met = np.flatnonzero(near[front].any(0) & (right < 0))
            right[met] = first
            front = np.flatnonzero(near[:, met].any(1) & (left < 0))
            left[front] = first
    return left, right


def tile_links(group: pa.Table, threshold: float) -> pa.Table:
    """``(rep, root, more)`` of the vectors of two tiles, or of one, that have links there."""
    side, lo, hi = (group.column(c).to_numpy() for c in ("tile", "lo", "hi"))
    rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
    a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    if not len(a) or not len(b):
        return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "root", "more")})
    x = matrix(group.column("v").take(pa.array(a)))
    y = x if lo[0] == hi[0] else matrix(group.column("v").take(pa.array(b)))
    rows, columns, near = _near(x, y, threshold)
    a, b = a[rows], b[columns]
    if lo[0] == hi[0]:
        near[a[:, None] == b[None, :]] = False  # no vector is its own link
    counted = [near[i : i + BLOCK] @ n[b] for i in range(0, len(a), BLOCK)]
    more_a = np.concatenate([np.zeros(0, np.int64), *counted])
    left, right = _spanned(near)
    out = [(rep[a], left, more_a)]
    if lo[0] != hi[0]:
        more_b = sum((n[a[i : i + BLOCK]] @ near[i : i + BLOCK] for i in range(0, len(a), BLOCK)), np.zeros(len(b), np.int64))
        out.append((rep[b], right, more_b))
    else:  # rows and columns are the same vectors; both of their links matter, one count
        out.append((rep[b], right, np.zeros(len(b), np.int64)))
    parts = [(r[to >= 0], rep[a][to[to >= 0]], m[to >= 0]) for r, to, m in out]
    return pa.table({c: np.concatenate(cell) for c, cell in zip(("rep", "root", "more"), zip(*parts))})


def _pairs(met: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """``tile_links`` of every two tiles; a row of ``met`` is a vector in its ``tile``, sent to meet ``_other``."""
    ends = [F.least("tile", "_other").alias("lo"), F.greatest("tile", "_other").alias("hi")]
    conf = met.sparkSession.conf
    # A number of partitions given here is kept; merged by size, all pairs of tiles could be one task.
    parts = max(met.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    meeting = met.select(*keys, *ends, "tile", "rep", "n", "v").repartition(parts, *keys, "lo", "hi")
    pairs = meeting.groupBy(*keys, "lo", "hi")
    return pairs.applyInArrow(lambda t: tile_links(t, threshold), "rep long, root long, more long")


def exact_links(classes: DataFrame, threshold: float, paired: int, tile: int, key: str = "dim") -> DataFrame:
    """``(rep, root, more)`` of all tile pairs of ``(rep, key, n, v)`` with equal ``key``; sums of ``more`` are exact."""
    sizes = classes.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    few = F.least(F.lit(LEAST_TILES), F.ceil(F.col("size") / paired))
    tiles = F.greatest(F.ceil(F.col("size") / tile), few).cast("int").alias("tiles")
    dealt = join_small(classes, sizes.select(key, tiles), [key], ["rep"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_other"))
    return _pairs(met, threshold, [key])


def _bits(size: Column, window: int) -> Column:
    """Signs of a prefix: runs of evenly spread vectors that share it are half a window long."""
    return F.least(F.lit(SIGNS), F.greatest(F.lit(0), F.ceil(F.log2(size / window)) + 1)).cast("int")


def _passes(bits: Column, threshold: float, miss: float) -> Column:
    """Passes that leave a pair at the threshold unmet with probability ``miss`` at most."""
    meet = F.pow(F.lit(1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi), bits)
    needed = F.ceil(F.lit(math.log(miss)) / F.log1p(-F.least(meet, F.lit(1 - 1e-12))))
    return F.when(bits == 0, 1).otherwise(F.greatest(F.lit(1), needed)).cast("int")


def sort_keys(classes: DataFrame) -> DataFrame:
    """Add ``keys``, one per pass, to ``(dim, passes, v)``: the first sign is the highest of ``SIGNS`` bits."""
    known: dict[tuple[int, int], np.ndarray] = {}

    def directions(dim: int, turn: int) -> np.ndarray:
        if (dim, turn) not in known:
            if len(known) * dim * SIGNS > 1 << 24:
                known.clear()
            known[dim, turn] = np.random.default_rng([SEED, dim, turn]).normal(size=(dim, SIGNS))
        return known[dim, turn]

    places = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, passes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "passes"))
        keys: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = matrix(batch.column("v").take(pa.array(at)))
            turns = [(x @ directions(int(dim), t) > 0) @ places for t in range(int(passes[at[0]]))]
            for i, row in zip(at, np.stack(turns, axis=1)):
                keys[i] = row
        return batch.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return map_batches(classes, step, f"{fields}, keys array<long>")


def pass_links(classes: DataFrame, threshold: float, window: int, miss: float) -> DataFrame:
    """``(rep, root)`` of the verified pairs that the passes over ``(rep, dim, n, v)`` find.

    A pair of vectors with a cosine of at least ``threshold`` is missed with probability ``miss`` at
    most. A pass compares about ``3 * window`` vectors with each, and every two of a longer run.
    """
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("size"))
    bits = sizes.select("dim", _bits(F.col("size"), window).alias("bits"))
    plan = bits.withColumn("passes", _passes(F.col("bits"), threshold, miss))
    keyed = sort_keys(join_small(classes, plan, ["dim"], ["rep"]))
    every = keyed.select("dim", "bits", "rep", "n", "v", F.posexplode("keys").alias("turn", "key"))
    order = ["dim", "turn", "key", "rep"]
    placed = numbered(every.select("bits", "n", "v", *order), "_at", *order)
    # The number of signs differs by row, which the shift functions of a column do not take.
    placed = placed.withColumn("tile", F.floor(F.col("_at") / window)).withColumn(
        "run", F.expr(f"shiftright(key, {SIGNS} - bits)")
    )
    run = ["dim", "turn", "run"]
    spans = placed.groupBy(*run).agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
    long = spans.where("last > first + 1")
    placed = join_small(placed, long, run, ["rep"], how="left")
    beside = F.array(F.col("tile") - 1, F.col("tile"), F.col("tile") + 1)
    within = F.when(F.col("first").isNull(), beside).otherwise(F.array_union(beside, F.sequence("first", "last")))
    # A longer run meets between blocks that do not touch; the rows of a block that are not of the run stay out.
    far = F.abs(F.col("_other") - F.col("tile")) > 1
    met = placed.select(*order[:2], "run", "tile", "rep", "n", "v", F.explode(within).alias("_other"))
    met = met.withColumn("run", F.when(far, F.col("run")).otherwise(F.lit(-1)))
    return _pairs(met, threshold, run).select("rep", "root")


def near_duplicates(
    df: DataFrame,
    ids: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    paired: int = PAIRED,
    tile: int = TILE,
    window: int = WINDOW,
    miss: float = MISS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per input row.

    Two vectors whose component is one have all their links counted; a link that no pass meets and
    that no chain of others replaces is missed, with probability ``miss`` at most.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of different length. A null id takes no part: no links, no component, not
    kept. Rows that repeat an id are rows of their own; they count as links of each other. An empty
    table gives an empty one.
    """
    rows = kept(usable(df, ids, vector), "vectors")
    same = rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    # Classes have numbers of their own, as ids can repeat with different vectors.
    classes = kept(numbered(same.withColumn("dim", F.size("v")), "rep", "id", "v"), "classes")
    links = kept(pass_links(classes, threshold, window, miss), "pairs")
    groups = kept(components(links, "rep", "root"), "groups").withColumnsRenamed({"node": "rep", "component": "comp"})
    members = kept(classes.join(groups, "rep"), "members")
    more = exact_links(members, threshold, paired, tile, "comp").groupBy("rep").agg(F.sum("more").alias("more"))
    least = members.groupBy("comp").agg(F.min("id").alias("least"))
    named = join_small(groups, least, ["comp"], ["rep"]).select("rep", "least")
    known = classes.join(named, "rep", "left").join(more, "rep", "left")
    by_vector = known.select(
        "v",
        (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("least", "id").alias("component_id"),
    )
    linked = join_small(rows, kept(by_vector, "by_vector"), ["v"], ["id"]).select("id", "n_links", "component_id")
    rest = df.where(~takes_part(F.col(ids), F.col(vector))).select(F.col(ids).cast("long").alias("id"))
    both = linked.unionByName(
        rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    )
    own = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return both.select(F.col("id").alias("vec_id"), "n_links", "component_id", own)
