"""Vector expressions and batch kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from convolens.functions.arrays import let, run_lengths

HASH_DIM = 64


def hash_embedding(toks: Column, dim: int = HASH_DIM) -> Column:
    """Signed feature hashing of a token list (Weinberger et al. 2009), as ``array<float>``.

    A token's MD5 picks one of ``2 * dim`` slots; even slots add to and odd slots subtract from
    position ``slot // 2``.
    """
    slots = F.transform(
        toks,
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(2 * dim)),
    )
    nothing = F.array().cast("array<struct<value:bigint,n:int>>")

    def dense(m: Column) -> Column:
        at = lambda slot: F.coalesce(F.try_element_at(m, slot.cast("long")), F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (at(i * 2) - at(i * 2 + 1)).cast("float")
        )

    return let(F.map_from_entries(F.coalesce(run_lengths(slots), nothing)), dense)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long float lists as a float64 matrix; a null list becomes zeros.

    Lists of different lengths raise: cut into rows anew they would give wrong products.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    dims = pc.unique(pc.list_value_length(column).drop_null()).to_pylist()
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths in one column: {sorted(dims)[:5]}")
    out = np.zeros((len(column), dims[0] if dims else 0))
    given = column.is_valid().to_numpy(zero_copy_only=False)
    out[given] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(given.sum()), -1) if dims and dims[0] else 0.0
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def cosines(m: np.ndarray, others: np.ndarray) -> np.ndarray:
    if not m.shape[1]:
        return np.zeros((m.shape[0], others.shape[0]))
    return unit_rows(m) @ unit_rows(others).T
