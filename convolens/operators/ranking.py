"""Top-k with a fixed tie order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores are rounded before they are ranked: the order in which a distributed sum adds up must not
# decide between equal messages.
DIGITS = 9


# A fused score is a ratio of already rounded numbers; fewer digits keep it off rounding ties.
FUSED_DIGITS = 6


def score(col: Column, digits: int = DIGITS) -> Column:
    return F.round(col, digits)


def top_k(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows overall, or per ``by`` group.

    Without groups this plans a per-task top-k. With groups the row-number filter plans a window
    group limit, so every task keeps at most ``k`` rows of a group before the shuffle and a hot
    group stays small.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col("_rn") <= k).drop("_rn")
