"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of their key. A keyed Feistel network permutes the numbers
below the next power of four; a result outside the table is permuted again until it falls inside,
which makes the network a permutation of exactly the row numbers. A row at permuted place ``p``
belongs to shard ``p % shards`` at slot ``p // shards``: shard and slot can be computed for any row
number without a table, and backwards with ``inverse``. Shards differ by one row at most
(law ``rows``); equal texts are not kept together, as no law on counts could hold if they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import RESERVED, map_batches, numbered

ROUNDS = 6
SEED = 20240
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def half_bits(n: int) -> int:
    """Bits of one half of the network: the smallest domain of 4**h values that holds ``n``."""
    return max(1, (max(n, 1) - 1).bit_length() + 1 >> 1)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit finaliser: multiply and shift until each input bit reaches each output bit."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, h: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << h) - 1), np.uint64(h)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(numbers, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The places of ``numbers`` (each below ``n``) in the shuffle, or with ``back`` the reverse."""
    x = np.asarray(numbers, dtype=np.uint64)
    h, keys = half_bits(n), [seed * 1_000_003 + r for r in range(ROUNDS)]
    with np.errstate(over="ignore"):
        out = _network(x, h, keys, back)
        walk = np.flatnonzero(out >= n)
        while len(walk):
            out[walk] = _network(out[walk], h, keys, back)
            walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def inverse(shard, slot, shards: int, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that lie at the given shards and slots."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def shard_rows(df: DataFrame, order: list[Column | str], shards: int, seed: int = SEED) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to ``df``.

    ``order`` names the rows; rows equal in it are told apart by the other columns, and rows equal
    in every column are interchangeable. Null keys come first. An empty table gives an empty one.
    Columns with the names added here, or with helper names (``RESERVED``), are dropped.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    plain = df.drop("row_number", "shard", "slot", *RESERVED)
    rest = [c for c, kind in plain.dtypes if not kind.startswith(("map", "variant"))]
    rows = numbered(plain, "row_number", *order, *rest)
    n = rows.count()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = permute(batch.column("row_number").to_numpy(), n, seed)
        out = batch.append_column("shard", pa.array((place % shards).astype(np.int32)))
        return out.append_column("slot", pa.array(place // shards))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, step, f"{fields}, shard int, slot long", rows=100_000)
