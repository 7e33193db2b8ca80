"""Message vectors, emotion scores and the dominant emotion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.functions.text import tokens
from convolens.functions.vectors import HASH_DIM, cosines, hash_embedding, matrix
from convolens.operators.grams import split, steps
from convolens.operators.ranking import DIGITS
from convolens.runtime import ranked, stored

# --- fixed values: the emotion labels, in order --------------------------------------------------
EMOTIONS = [
    "Joy", "Happiness", "Sadness", "Anger", "Love", "Fear",
    "Surprise", "Excitement", "Frustration", "Gratitude", "Despair", "Normal",
]
# -------------------------------------------------------------------------------------------------

# Encoder: a list of texts to one vector each. The factory runs once per task.
Encoder = Callable[[Sequence[str]], np.ndarray]


def embed(
    df: DataFrame,
    text_col: str,
    encoder_factory: Callable[[], Encoder] | None = None,
    out: str = "vector",
    dim: int = HASH_DIM,
    batch_size: int = 1000,
) -> DataFrame:
    """Add a vector column.

    Without an encoder the vectors are feature hashes, computed by expressions alone. A caller's
    encoder is loaded once per task and fed ``batch_size`` texts at a time.
    """
    if encoder_factory is None:
        return df.withColumn(out, hash_embedding(tokens(F.col(text_col)), dim))

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for texts in batches:
            parts = [
                np.asarray(encoder(texts.iloc[i : i + batch_size].fillna("").tolist()), np.float32)
                for i in range(0, len(texts), batch_size)
            ]
            yield pd.Series([v for part in parts for v in part], index=texts.index)

    # Written out, because the annotations of a nested function are strings here.
    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(encode, "array<float>")(text_col))


# Rows whose feature hashes are dense at a time.
HASH_ROWS = 10_000


def hashed(tokens: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """``(chat_id, seq, vector)`` of ``index.token_lists``: the feature hashes of ``embed``, each word of a step hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tokens"):
            flat, row = split(batch.column("tokens"))
            coded = flat.dictionary_encode()
            firsts = [int(md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) for w in coded.dictionary.to_pylist()]
            slot = (np.array(firsts, np.int64) % (2 * dim))[coded.indices.to_numpy()]
            for start in range(0, batch.num_rows, HASH_ROWS):
                part = batch.slice(start, HASH_ROWS)
                a, b = np.searchsorted(row, [start, start + part.num_rows])
                cell = (row[a:b] - start) * (2 * dim) + slot[a:b]
                sums = np.bincount(cell, minlength=part.num_rows * 2 * dim).reshape(-1, dim, 2)
                values = (sums[:, :, 0] - sums[:, :, 1]).astype(np.float32).ravel()
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                lists = pa.ListArray.from_arrays(ends, pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("chat_id"), part.column("seq"), lists], ["chat_id", "seq", "vector"])

    return tokens.select("chat_id", "seq", "tokens").mapInArrow(run, "chat_id string, seq long, vector array<float>")


# Labels that go to the tasks with the plan, and the blocks in which more of them meet vectors.
LABEL_BLOCK = 10_000
# Vectors of a block, where there are several blocks of labels.
VECTOR_BLOCK = 5_000


def emotion_scores(
    df: DataFrame, vector_col: str, labels: DataFrame, out: str = "emotion_similarities"
) -> DataFrame:
    """Add the cosine to every label and the best label; the first label wins ties.

    ``labels`` is ``(label, ord, vector)``. Up to ``LABEL_BLOCK`` of them go to the tasks, which
    multiply them with a batch of vectors at a time; all columns of ``df`` travel along, so select
    the ones needed first. More labels stay a table: blocks of them meet blocks of vectors by key,
    and the scores of a row are put together in the order of the blocks.
    """
    columns = df.columns
    known = labels.select("label", "ord", "vector")
    head = known.orderBy("ord").limit(LABEL_BLOCK + 1).collect()
    if not head:
        raise ValueError("no labels")
    if len(head) > LABEL_BLOCK:
        return _scores_by_block(df, vector_col, known, out)
    names, targets = [str(r["label"]) for r in head], np.asarray([r["vector"] for r in head], np.float64)
    scored = _with_scores(df, vector_col, names, targets, "_scores", "_label")
    return scored.select(*columns, F.col("_scores").alias(out), F.col("_label").alias("dominant_emotion"))


def _scores_by_block(df: DataFrame, vector_col: str, labels: DataFrame, out: str) -> DataFrame:
    """``emotion_scores`` for any number of labels; none of them pass through the driver."""
    placed = ranked(labels, [F.asc("ord"), F.asc("label")], "_nth")
    known = stored(placed.withColumn("_l", F.floor((F.col("_nth") - 1) / LABEL_BLOCK).cast("int")))
    rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
    tall = known.agg(F.max("_l")).first()[0] + 1
    wide = max(1, ceil(rows.count() / VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A number of partitions given here is kept; merged by size, the pairs would end in few tasks.
    parts = min(tall * wide, 8 * df.sparkSession.sparkContext.defaultParallelism)
    meeting = lambda x: x.repartition(parts, "_v", "_l").groupBy("_v", "_l")
    v = rows.select("_row", F.col(vector_col).alias("_vector"), F.pmod(F.xxhash64("_row"), F.lit(wide)).cast("int").alias("_v"))
    left = v.select("*", every(tall).alias("_l"))
    right = known.select("_l", "_nth", F.col("label").cast("string").alias("label"), "vector", every(wide).alias("_v"))
    shape = pa.schema([("_row", pa.int64()), ("_l", pa.int32()), ("scores", pa.list_(pa.float64())), ("label", pa.string())])

    def meet(some: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(some) or not len(wanted):
            return shape.empty_table()
        wanted = wanted.sort_by("_nth")
        found = np.round(cosines(matrix(some.column("_vector")), matrix(wanted.column("vector"))), DIGITS) + 0.0
        ends = pa.array(np.arange(0, found.size + 1, len(wanted), dtype=np.int32))
        first = wanted.column("label").take(pa.array(found.argmax(axis=1)))
        block = pa.array(np.full(len(some), wanted.column("_l")[0].as_py()), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
        return pa.table([some.column("_row"), block, lists, first], schema=shape)

    met = meeting(left).cogroup(meeting(right)).applyInArrow(meet, "_row long, _l int, scores array<double>, label string")
    best = F.struct(F.array_max("scores").alias("score"), (-F.col("_l")).alias("_l"), "label")
    whole = met.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("_l", "scores"))).alias("_parts"), F.max(best).alias("_best")
    )
    joined = rows.join(whole, "_row")
    scores = F.flatten(F.transform("_parts", lambda p: p["scores"])).alias(out)
    return joined.select(*df.columns, scores, F.col("_best.label").alias("dominant_emotion"))


def _with_scores(
    df: DataFrame, vector_col: str, names: list[str], targets: np.ndarray, scores: str, label: str
) -> DataFrame:
    """Add the cosines to some labels and the first of the best of them."""
    added = [T.StructField(scores, T.ArrayType(T.DoubleType())), T.StructField(label, T.StringType())]

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(vector_col))
            found = np.round(cosines(matrix(vectors), targets), DIGITS) + 0.0
            offsets = np.arange(0, found.size + 1, len(names), dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            first = pa.array([names[i] for i in found.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column, first], names=[*batch.schema.names, scores, label]
            )

    return df.mapInArrow(similar, T.StructType([*df.schema.fields, *added]))


def emotion_labels(
    spark, names: Sequence[str] = EMOTIONS, encoder_factory: Callable[[], Encoder] | None = None
) -> DataFrame:
    """The label table for ``emotion_scores``, encoded like the messages."""
    table = spark.createDataFrame(list(enumerate(names)), "ord int, label string")
    return embed(table, "label", encoder_factory)
