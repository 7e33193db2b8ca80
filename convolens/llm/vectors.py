"""Vector columns as the operators of this subpackage take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(ids: Column, vector: Column) -> Column:
    """Whether a row has an id and a vector that is not empty, zero, or partly null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(ids.isNotNull() & vector.isNotNull() & finite & nonzero, F.lit(False))


def usable(df: DataFrame, ids: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    rows = df.where(takes_part(F.col(ids), F.col(vector)))
    return rows.select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("v"))


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)
