"""Session helpers: shared scratch storage and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Largest table side that is broadcast; the tables in question are narrow (a key and a weight).
BROADCAST_ROWS = 200_000
# Most key values that are turned into a scan filter.
FILTER_VALUES = 1000
# Number of copies of the small side when a hot key has to be split.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only where the session names none and runs on one machine; on a
    cluster, where every executor would write to a disk of its own, that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="convolens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder, noted for ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch tables this application has written; the number of paths.

    Call it when results that were not stored elsewhere are no longer needed: plans that read
    scratch tables fail afterwards. Only paths handed out by ``scratch_path`` are touched, through
    the file system they lie in.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a file scan that has fewer partitions than the cluster has cores.

    A table in one small file is one task, however costly the text work on each row. Large tables
    have enough partitions and come back unchanged. Pass plain scans only.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; never reads more than it has to."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    bound: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join a large table with one that is usually small.

    The small side is broadcast when a count proves it small, so ``big`` is not shuffled. Beyond
    that both sides are shuffled on ``on`` plus a salt taken from ``spread_by`` (columns of
    ``big``), which splits a hot key over ``SALTS`` tasks; the copies are never broadcast, as their
    size is that of the files they come from in Spark's eyes. ``bound`` is a row limit the caller has
    already built into ``small``; it saves the count. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    if bound <= max_rows if bound is not None else fits(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def keep_keys(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Restrict ``big`` to the key values of ``small`` before it is read, where they are few.

    A join alone does not reach the file scan. The literal filter does, and a table sorted by the
    key then skips the row groups that cannot match. ``small`` should be stored or cheap.
    """
    values = [r[0] for r in small.select(key).distinct().limit(FILTER_VALUES + 1).collect()]
    return big.where(F.col(key).isin(values)) if len(values) <= FILTER_VALUES else big


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the place in ``order`` from 1, for any number of rows: no task sorts more than its range.

    Give an order without ties. Only one count per partition leaves the tasks.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(placed.withColumn("_place", F.monotonically_increasing_id()))
    part, row = F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    joined = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + row + 1).drop("_part", "_place", "_before")


def failed_job(e: Exception) -> str | None:
    """What a job failed of, in one line; null for errors of the plan itself, which are the program's."""
    if isinstance(e, AnalysisException) or not isinstance(e, (PySparkException, Py4JJavaError)):
        return None
    lines = [line.strip() for line in str(e).splitlines() if line.strip()]
    told = [line for line in lines if re.match(r"[\w.]*(Error|Exception)\b", line)]
    return (told or lines or ["unknown"])[-1][:300]


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, until ``release``."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
