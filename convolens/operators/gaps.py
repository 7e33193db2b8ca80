"""Next author and time to the next message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.runtime import stored

# Groups up to this many messages are ordered by a plain window in one task.
WINDOW_ROWS = 5_000_000


def next_message(
    messages: DataFrame, by: Sequence[str] = ("chat_id",), max_group_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Add ``next_user``, ``next_time`` and ``gap_sec`` in time order, per ``by`` group.

    ``by=()`` orders all messages as one sequence. Ties in time follow ``(chat_id, seq)``. Rows
    without a time are left out. A count decides the plan: groups that fit a task use ``lead``
    directly, anything else is range-partitioned so that neither one huge chat nor one busy moment
    ends up in a single task.
    """
    timed = messages.where(F.col("date_time").isNotNull())
    if by and _largest_group(timed, by) <= max_group_rows:
        order = W.partitionBy(*by).orderBy("date_time", "chat_id", "seq")
        return _with_gap(
            timed,
            F.lead("user").over(order),
            F.lead("date_time").over(order),
        )
    return _ranged(timed, by)


def answered(gaps: DataFrame) -> DataFrame:
    """Rows whose next message is by someone else, and each sequence's last row."""
    return gaps.where(F.col("user").isNotNull() & ~F.col("user").eqNullSafe(F.col("next_user")))


def _largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _with_gap(df: DataFrame, next_user: Column, next_time: Column) -> DataFrame:
    return df.withColumns({"next_user": next_user, "next_time": next_time}).withColumn(
        "gap_sec",
        F.expr("timestampdiff(MICROSECOND, date_time, next_time)") / F.lit(1e6),
    )


def _ranged(timed: DataFrame, by: Sequence[str]) -> DataFrame:
    """``lead`` over range partitions, with each partition's last row filled from the next one.

    The sort key ends in the message id, so it is unique and the sampled ranges are even whatever
    the data looks like. The partition number is only stable once it is stored. The first row of each partition is the only thing that crosses partitions: as many
    rows as there are partitions.
    """
    key = list(dict.fromkeys([*by, "date_time", "chat_id", "seq"]))
    placed = stored(timed.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()))
    within = W.partitionBy("_part", *by).orderBy("date_time", "chat_id", "seq")
    first = F.struct(*[F.col(c) for c in key], F.col("user"))
    heads = placed.groupBy("_part", *by).agg(F.min(first).alias("_head"))
    # Following head of the same group: partitions are ordered, so this is the smallest later one.
    # One row per partition (plus one per group start) goes through this window.
    starts = W.partitionBy(*by).orderBy("_part") if by else W.orderBy("_part")
    following = heads.select("_part", *by, F.lead("_head").over(starts).alias("_next")).where(
        F.col("_next").isNotNull()
    )
    joined = placed.withColumns(
        {
            "_user": F.lead("user").over(within),
            "_time": F.lead("date_time").over(within),
        }
    ).join(F.broadcast(following), ["_part", *by], "left")
    last = F.col("_time").isNull()
    return _with_gap(
        joined,
        F.when(last, F.col("_next.user")).otherwise(F.col("_user")),
        F.when(last, F.col("_next.date_time")).otherwise(F.col("_time")),
    ).drop("_part", "_user", "_time", "_next")
