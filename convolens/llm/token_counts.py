"""Token counts of whole documents, huge ones by overlap resynchronisation.

A huge document is cut into chunks that overlap. Each chunk is encoded alone with offsets. The
tokenizer's pattern is matched from left to right and looks ahead by a few characters only, so
once a chunk and its predecessor both cut at the same place, and the predecessor's cut is far enough
from its end, everything after that place is the same in both. There they are spliced. By
induction from the document's start every splice lies on a true cut. A pair of chunks without a common
cut (say, one endless word) sends its document to another round with overlaps and chunks widened;
the last round holds the document in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import kept, map_batches
from convolens.llm.tokens import byte_counter, vocabulary

CHUNK = 65_536
OVERLAP = 2_048
WIDEN = 4
# A cut this far from a chunk's end cannot change with what follows: contractions look two
# characters ahead, special strings need 13.
MARGIN = 16

_PARTS = "_tag long, chunk int, n int, head array<struct<at: long, n: int>>, tail array<struct<at: long, n: int>>"


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk of each document, dealt out over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, text in zip(batch.column("_tag").to_pylist(), batch.column("text")):
                text = text.as_py()
                step = chunk - overlap
                starts = range(0, max(1, len(text) - overlap), step)
                for i, start in enumerate(starts):
                    end = len(text) if i == len(starts) - 1 else start + chunk
                    yield pa.RecordBatch.from_pydict(
                        {
                            "_tag": pa.array([tag], pa.int64()),
                            "chunk": pa.array([i], pa.int32()),
                            "start": pa.array([start], pa.int64()),
                            "last": pa.array([i == len(starts) - 1]),
                            "part": pa.array([text[start:end]]),
                        }
                    )

    return docs.mapInArrow(run, "_tag long, chunk int, start long, last boolean, part string")


def _cuts(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per chunk its token count and the cuts in its two overlaps with the tokens before each."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = byte_counter(path)
        rows = []
        for r in batch.to_pylist():
            at, before, n = counter.boundaries(r["part"])
            size = len(r["part"])
            head = (at < overlap) if r["chunk"] else np.zeros(len(at), bool)
            tail = (at >= size - overlap) & (at <= size - MARGIN) & (not r["last"])
            listed = lambda keep: [
                {"at": int(a) + r["start"], "n": int(b)} for a, b in zip(at[keep], before[keep])
            ]
            rows.append({"_tag": r["_tag"], "chunk": r["chunk"], "n": n, "head": listed(head), "tail": listed(tail)})
        cut = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32())]))
        kinds = [("_tag", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("head", cut), ("tail", cut)]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return map_batches(chunks, step, _PARTS, rows=16)


def _spliced(cuts: DataFrame) -> DataFrame:
    """``(_tag, n_tokens)``; null where some pair of chunks has no common cut."""
    by_doc = Window.partitionBy("_tag").orderBy("chunk")
    pair = cuts.withColumn("_before", F.lag("tail").over(by_doc))
    places = lambda c: F.transform(c, lambda x: x["at"])
    common = F.array_min(F.array_intersect(places(F.col("_before")), places(F.col("head"))))
    at = pair.withColumn("_at", common)
    inside = lambda c: F.get(F.filter(c, lambda x: x["at"] == F.col("_at")), F.lit(0))["n"]
    # Tokens of the predecessor up to the splice, less those of this chunk before it.
    gain = F.col("n") + F.when(F.col("chunk") > 0, inside("_before") - F.col("_n_before") - inside("head")).otherwise(0)
    rows = at.withColumn("_n_before", F.lag("n").over(by_doc)).withColumn("_gain", gain)
    total = F.when(F.count("_gain") == F.count(F.lit(1)), F.sum("_gain"))
    return rows.groupBy("_tag").agg(total.cast("long").alias("n_tokens"))


def count_huge(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(_tag, n_tokens)`` of documents ``(_tag, text)``, all by overlapping chunks."""
    if not MARGIN < overlap <= chunk // 2:
        raise ValueError("the overlap must be longer than the margin and at most half a chunk")
    done = None
    while True:
        pieces = _chunks(docs, chunk, overlap).repartition("_tag", "chunk")
        found = kept(_spliced(_cuts(pieces, path, overlap)), "tokens")
        whole = found.where(F.col("n_tokens").isNotNull())
        done = whole if done is None else done.unionByName(whole)
        failed = found.where(F.col("n_tokens").isNull()).select("_tag")
        if failed.isEmpty():
            return done
        docs = docs.join(failed, "_tag", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 1024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to documents with a ``text`` column.

    Null texts count as empty: no bytes, no tokens. Documents longer than ``chunk`` characters
    are spliced from overlapping chunks; the others are encoded in batches, each on its own. Every
    input row gives one row, equal rows included. Columns of those names are replaced.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", "_tag", "text")]
    plain = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    sized = plain.withColumn("n_bytes", F.octet_length("text").cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema if f.name != "text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = byte_counter(path)
        counts = [counter.count(t) for t in batch.column("text").to_pylist()]
        return batch.drop_columns(["text"]).append_column("n_tokens", pa.array(counts, pa.int64()))

    # Bytes bound characters from above, so short documents are known without counting.
    longer = (F.col("n_bytes") > chunk) & (F.char_length("text") > chunk)
    short = map_batches(sized.where(~longer), step, f"{fields}, n_tokens long")
    huge = kept(sized.where(longer).withColumn("_tag", F.monotonically_increasing_id()), "huge")
    spliced = count_huge(huge.select("_tag", "text"), path, chunk, overlap)
    counted = huge.drop("text").join(spliced, "_tag").select(*short.columns)
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
