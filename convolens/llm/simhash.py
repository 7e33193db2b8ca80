"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Cut into ``b`` blocks, two fingerprints with at most ``d`` differing bits
agree in at least ``b - d`` blocks, so they meet under the key of some choice of ``b - d`` blocks.
Candidates that meet are verified by their Hamming distance. Equal fingerprints are one row
throughout, and the number of blocks follows from their number so that unrelated fingerprints
rarely meet; whatever it is, no close pair is missed.

Members of a key that many fingerprints share (a large family of near copies) are not paired: they
are cut into tiles, every two tiles are compared in one task, and a task reports a spanning forest
of its links, never all of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import kept, map_batches
from convolens.llm.components import components
from convolens.runtime import join_small

BITS = 64
WORDS = 4
DISTANCE = 4
SEED = 42
TILE = 1024
# Keys with more members than this are compared in tiles instead of by a join.
PAIRED = 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, as an unsigned number.

    Bit ``i`` is set if it is set in over half of the hashes of all shingles, repeats included.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[len(tokens) - n :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    columns = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    out = 0
    for i in range(8):
        ones = np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS
        out = out << 8 | int(np.packbits(2 * ones > n)[0])
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, row: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` of documents with ``doc_id`` and ``text``; ``fp`` holds the bits as a long.

    ``row`` names a column of longs that tells rows of one id apart; it is passed on as ``row``.
    """
    more = ["row"] if row else []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        names = ["doc_id", *more]
        columns = [batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], [*names, "fp"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(row).alias("row")] if row else [])]
    return map_batches(docs.select(columns), step, "doc_id long, " + "row long, " * len(more) + "fp long")


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys have enough bits to tell ``n`` fingerprints apart."""
    for b in range(distance + 1, 2 * distance + 1):
        if n <= 2 ** (BITS * (b - distance) // b):
            return b
    return 2 * distance


def masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of ``blocks - distance`` blocks, as signed numbers."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links from one member to each other member of every component of a 0/1 matrix."""
    n, out = len(near), []
    fresh = near.any(axis=1)
    while fresh.any():
        root = int(fresh.argmax())
        seen = np.zeros(n, dtype=bool)
        front = np.array([root])
        seen[root] = True
        while len(front):
            new = near[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        fresh &= ~seen
        out += [(root, int(i)) for i in np.flatnonzero(seen) if i != root]
    return out


def tile_links(group: pa.Table, distance: int) -> pa.Table:
    """Spanning links of one tile, or between two tiles."""
    name, side = group.column("fp").to_numpy(), group.column("tile").to_numpy()
    fp = name.view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    if (side != side[0]).any():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    pairs = np.array(_forest(near), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": name[pairs[:, 0]], "b": name[pairs[:, 1]]})


def close_links(prints: DataFrame, distance: int = DISTANCE, paired: int = PAIRED, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` reachable from each
    other by steps of at most ``distance`` bits."""
    blocks = blocks_for(prints.count(), distance)
    keys = F.array(*[F.lit(m) for m in masks(blocks, distance)])
    rows = prints.select("fp", F.posexplode(keys).alias("choice", "mask"))
    rows = rows.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(rows.join(shared, ["choice", "key"]), "members")
    few = members.where(F.col("n") <= paired).drop("n")
    other = few.withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    pairs = few.join(other, ["choice", "key"]).where((F.col("fp") < F.col("b")) & close)
    small = pairs.select(F.col("fp").alias("a"), "b")
    many = members.where(F.col("n") > paired).withColumn(
        "tiles", F.ceil(F.col("n") / tile).cast("int")
    )
    many = many.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = many.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_other"))
    ends = [F.least("tile", "_other").alias("lo"), F.greatest("tile", "_other").alias("hi")]
    tiles = met.select("choice", "key", *ends, "tile", "fp").groupBy("choice", "key", "lo", "hi")
    large = tiles.applyInArrow(lambda t: tile_links(t, distance), "a long, b long")
    return small.unionByName(large).distinct()


def near_duplicates(
    docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, row: str | None = None, **options
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_same)``, a row per document.

    ``row`` names a column of longs that is passed on as ``row``, to tell rows of one id apart.

    ``component_id`` is the smallest ``doc_id`` reachable by steps of at most ``distance`` bits;
    ``n_same`` counts documents with the same fingerprint. Null and empty texts have fingerprint
    zero and link like any other. A row with a null ``doc_id`` links too but cannot name a
    component; where no row of a component has an id, it is null. Repeated rows stay. An empty
    table gives an empty one.
    """
    marked = kept(fingerprints(docs, words, row), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_same"))
    prints = kept(distinct, "prints")
    groups = components(close_links(prints.select("fp"), distance, **options)).withColumnRenamed("node", "fp")
    joined = prints.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = kept(joined.join(least, "component").select("fp", "n_same", "component_id"), "labelled")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    # A third of all rows may share a fingerprint, so a long list of them is salted.
    named = join_small(marked, labelled, ["fp"], spread_by=["doc_id"])
    return named.select("doc_id", *(["row"] if row else []), text, "component_id", "n_same")
