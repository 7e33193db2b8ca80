"""Array expressions used by the text and vector functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def run_lengths(values: Column) -> Column:
    """Distinct values with their counts, as ``array<struct<value, n>>``.

    Sorting and cutting at the changes keeps the count local to the row: no shuffle is needed to
    turn a token list into term frequencies, and the cost stays n log n for long texts.
    """

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("value"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    # A null or empty list has no runs: null, which explodes to no rows.
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, cut(s)))
