"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolens.runtime import join_small, scratch_path, spread

# Rows of one Arrow step inside a task; a whole input batch is at most 64 MB by Spark's own limit.
STEP_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, spread over the cores when it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores until no column of the frames has it (case does not count)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few texts at a time become Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = STEP_ROWS
) -> DataFrame:
    """Apply ``step`` to slices of at most ``rows`` rows of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(step, slices(batches, rows))

    return df.mapInArrow(run, schema)


# Names of the helper columns; columns of the caller with these names are dropped.
RESERVED = ("_part", "_row", "_n", "_before")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted over the cluster and stored, with ``_part`` and ``_row``, its place in there.

    The place is stored with the row, so later passes agree however often they are computed. Give
    an order without ties, or with ties only between equal rows.
    """
    ranged = df.drop(*RESERVED).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_row", place)
    split = numbered.withColumn("_part", F.shiftright("_row", 33).cast("int")).withColumn(
        "_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    )
    return kept(split, "ordered")


def offsets(parts: DataFrame, total: str, name: str) -> DataFrame:
    """Running total before each ``_part`` of a table with one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum(total).over(before), F.lit(0)).alias(name))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Add the row number from 0 in the given order as ``name``.

    Only one count per partition leaves the tasks; there are as many as shuffle partitions, so
    the table of offsets is small enough to broadcast whatever the input.
    """
    placed = in_order(df, *order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(F.broadcast(offsets(counts, "_n", "_before")), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def read_in_order(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``, a double: where a row stands among all rows of the files that ``df`` is a scan of.

    Files go by the numbers their writing tasks gave them, so a table that was written in an order
    over the cluster has it back. Null where ``df`` is no plain scan of written files.
    """
    try:
        if "_metadata" in df.columns:
            raise AnalysisException("a column of the caller")
        file, row = free_name("_file", df), free_name("_line", df)
        whole = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        files = df.select(F.col("_metadata.file_path").alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias("_lines"))
    except AnalysisException:
        return df.withColumn(name, F.lit(None).cast("double"))
    number = F.regexp_extract(F.element_at(F.split(file, "/"), -1), r"^part-(\d+)-", 1).try_cast("double")
    files = files.select(file, number.alias("_number"), "_lines")
    place = F.col("_number") + F.col(row) / F.col("_lines")
    return join_small(whole, files, [file], [row]).withColumn(name, place).select(*df.columns, name)
