"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a broken line. Its integral up to ``t``,
scaled to the source's token target, is the demand ``D(t)``: how many tokens of the source should
have been served by then. Documents of a source stand in a fixed pseudo-random queue that repeats
until its target is met; a copy whose middle lies ``u`` tokens into the queue is trained at
``t`` with ``D(t) = u``. Sorting all copies by that position over the cluster gives the training
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import free_name, in_order, kept

# Relative rates at equally spaced times, per schedule; a source takes the schedule of its place.
SCHEDULES = ((1.0, 1.0, 1.0, 1.0, 1.0), (2.0, 1.5, 1.0, 0.5, 0.25), (0.25, 0.5, 1.0, 1.5, 2.0))
WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Add ``weight``, ``place`` and ``target`` to ``(source, source_size)``, a row per source.

    Sources in code-point order (null last) get the weights in turn. Filling up by weight stops at
    ``max_epochs`` times a source's size: in order of size per weight, the first source whose fair
    share of what is left fits below its limit sets the level for itself and all later ones.
    """
    everything = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(everything) - 1).withColumn(
        "weight", F.get(table, (F.col("place") % len(weights)))
    )
    limit = F.col("source_size") * F.lit(float(max_epochs))
    whole = Window.partitionBy()
    by_fill = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole) * F.lit(float(share))
        - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    fits = F.col("_level") * F.col("weight") <= limit
    return (
        placed.withColumn("_level", level)
        .withColumn("_level", F.max(F.when(fits, F.col("_level"))).over(whole))
        .withColumn(
            "target",
            F.coalesce(F.least(limit, F.col("_level") * F.col("weight")), limit),
        )
        .drop("_level")
    )


def position(used: Column, schedule: Column, steps: int) -> Column:
    """The time at which a share ``used`` (0..1) of a source's demand has been served.

    ``schedule`` holds rates at ``steps + 1`` equally spaced times. Demand is quadratic between
    two of them; the segment is found from the running integral, then the root is taken.
    """
    at = lambda i: F.get(schedule, F.lit(i))
    area = [(at(i) + at(i + 1)) / 2 / steps for i in range(steps)]
    total = sum(area[1:], area[0])
    want = used * total
    done, out = F.lit(0.0), F.lit(1.0)
    pieces = []
    for i in range(steps):
        rest = F.greatest(want - done, F.lit(0.0))
        slope = (at(i + 1) - at(i)) * steps
        root = F.sqrt(F.greatest(at(i) * at(i) + 2 * slope * rest, F.lit(0.0)))
        bottom = at(i) + root
        inside = F.when(bottom > 0, 2 * rest / bottom).otherwise(0.0)
        pieces.append((want <= done + area[i], F.lit(i / steps) + F.least(inside, F.lit(1.0 / steps))))
        done = done + area[i]
    for found, time in reversed(pieces):
        out = F.when(found, time).otherwise(out)
    return out


def curriculum(
    docs: DataFrame,
    text: str = "text",
    keys: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
) -> tuple[DataFrame, DataFrame]:
    """``(plan, order)`` of a mix of ``docs`` (columns ``doc_id``, ``source`` and ``text``).

    ``plan`` has a row per document: ``keys, source, size, source_size, target, copies, taken``
    and ``positions``, the training times of its copies. ``order`` has a row per copy with
    ``keys, source, size, copy, position``, range-sorted by position. A document is served
    ``copies`` times, ``max_epochs`` at most: copy ``c`` is taken when its middle lies below the
    target, so a source misses its target by half a document at most, twice that where an epoch
    ends. Null texts have size 0 and are taken like any other text. The queue order is the
    MD5 of the id, so reruns agree; equal ids are told apart by size. An empty table gives empty
    results. Null sources form one source.
    """
    steps = len(schedules[0]) - 1
    if any(len(s) != steps + 1 or min(s) < 0 or max(s) <= 0 for s in schedules):
        raise ValueError("schedules need equal lengths and rates of 0 or more")
    sized = docs.select(*keys, "source", word_count(F.col(text)).alias("size"))
    key = F.md5(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")))
    placed = in_order(sized.withColumn("_key", key), "source", "_key", *keys, "size")
    # Running totals: inside each stored partition, and over the partitions of a source.
    inside = Window.partitionBy("_part", "source").orderBy("_row")
    summed = placed.withColumn("_upto", F.sum("size").over(inside))
    parts = placed.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "parts")
    sources = targets(
        parts.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs
    )
    known = parts.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    known = known.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_before", "source_size", "target", "place")
    both = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    # One row per source and partition: no more than sources plus partitions.
    joined = summed.join(known, both)
    middle = F.col("_before") + F.col("_upto") - F.col("size") / 2
    times = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    epochs = F.transform(
        F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda c: c * F.col("source_size") + F.col("_middle")
    )
    served = F.filter(epochs, lambda u: (u < F.col("target")) | (F.col("source_size") == 0))
    schedule = F.get(times, F.col("place") % len(schedules))
    share_of = lambda u: F.when(F.col("target") > 0, u / F.col("target")).otherwise(F.lit(0.0))
    plan = (
        joined.withColumn("_middle", middle)
        .withColumn("_served", F.slice(served, 1, max_epochs))
        .withColumn("copies", F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.size("_served")))
        .withColumn("_schedule", schedule)
        .withColumn(
            "positions",
            F.transform(
                F.slice("_served", 1, F.col("copies")),
                lambda u: position(share_of(u), F.col("_schedule"), steps),
            ),
        )
        .select(
            *keys, "source", "size", "source_size", "target", "copies",
            (F.col("size") * F.col("copies")).alias("taken"), "positions",
        )
    )
    order = plan.select(*keys, "source", "size", F.posexplode("positions").alias("copy", "position"))
    place = ["position", *keys, "copy"]
    return plan, order.repartitionByRange(*place).sortWithinPartitions(*place)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order, each row as often as the mix takes it.

    Only ids, sizes and a hash of each row take part in planning. Positions come back to the texts
    by an equi-join on both; rows equal in every column are interchangeable, so where such rows
    exist one of them takes all their positions.
    """
    columns = docs.columns
    row, name, place = (free_name(f"_mix_{c}", docs) for c in ("hash", "id", "position"))
    keyed = docs.withColumn(row, F.xxhash64(*columns))
    keyed = keyed.withColumn(name, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    plan, _ = curriculum(keyed.select(name, row, "source", "text"), keys=(name, row), **options)
    served = kept(plan.select(name, row, "positions"), "plan")
    rows = served.groupBy(name, row).agg(F.count(F.lit(1)).alias("n"))
    if not rows.where("n > 1").isEmpty():
        listed = F.flatten(F.collect_list("positions")).alias("positions")
        served = served.groupBy(name, row).agg(listed)
        keyed = keyed.dropDuplicates([name, row])
    copies = served.select(name, row, F.explode("positions").alias(place))
    placed = keyed.join(copies, [name, row])
    order = [place, name, row]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
