"""Products of sparse messages and sparse requests, without a table of pairs.

A message is a row with the list of its keys (words or terms) and, where they differ from one, their
weights. Requests are rows ``(query_id, key, weight)``. A block of requests is a sparse matrix in
rows of keys; a task multiplies its messages with it and keeps ``k`` rows per request.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.operators.best import Best
from convolens.operators.ranking import DIGITS
from convolens.runtime import BROADCAST_ROWS, fits, stored

# Weights of a block of requests: one block goes to the tasks with the plan.
BLOCK_WEIGHTS = BROADCAST_ROWS
# As many times the weights of such a block make one where there are several: every block of messages
# is sent to each, so fewer and larger ones shuffle less.
GRID = 8
# Keys of a block of messages, where there are several blocks of requests.
BLOCK_KEYS = 2_000_000
# Products that a task holds at a time.
PRODUCTS = 4_000_000

HITS = "query_id string, chat_id string, seq long, score double"
IDS = ["chat_id", "seq"]


class Requests:
    """A block of requests as a sparse matrix in rows of keys."""

    def __init__(self, query_ids: pa.Array, keys: pa.Array, weights: np.ndarray):
        query, key = query_ids.dictionary_encode(), keys.dictionary_encode()
        self.names, self.keys = query.dictionary, key.dictionary
        code = key.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.starts = np.searchsorted(code[order], np.arange(len(self.keys) + 1))
        self.query = query.indices.to_numpy()[order].astype(np.int64)
        self.weight = np.asarray(weights, dtype=np.float64)[order]

    @classmethod
    def of(cls, table: pa.Table) -> Requests:
        whole = table.combine_chunks()
        part = lambda c: _chunk(whole.column(c))
        return cls(part("query_id").cast(pa.string()), part("key").cast(pa.string()), part("weight").to_numpy())

    def scores(
        self, message: np.ndarray, keys: pa.Array, own: np.ndarray | None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(message, query, score)`` of all pairs that share a key; ``message`` ascends."""
        code = pc.index_in(keys, value_set=self.keys)
        known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        code = code.take(pa.array(known)).to_numpy().astype(np.int64)
        message = message[known]
        own = np.ones(len(known)) if own is None else own[known]
        count = self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(count)
        # Cuts lie between messages.
        fresh = np.flatnonzero(np.r_[True, message[1:] != message[:-1]]) if len(message) else np.array([], int)
        start = 0
        while start < len(message):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + PRODUCTS, side="right"))
            cut = int(np.searchsorted(fresh, stop, side="right")) - 1
            stop = len(message) if stop >= len(message) else int(fresh[cut])
            if stop <= start:  # one message alone has more
                after = int(np.searchsorted(fresh, start, side="right"))
                stop = int(fresh[after]) if after < len(fresh) else len(message)
            yield self._product(message[start:stop], code[start:stop], own[start:stop], count[start:stop])
            start = stop

    def _product(self, message, code, own, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = int(count.sum())
        cell = np.arange(total) + np.repeat(self.starts[code] - (np.cumsum(count) - count), count)
        pair = np.repeat(message, count) * len(self.names) + self.query[cell]
        product = np.repeat(own, count) * self.weight[cell]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if total else np.array([], int)
        score = np.add.reduceat(product[order], first) if total else product
        # -0.0 would rank apart from 0.0.
        return pair[first] // len(self.names), pair[first] % len(self.names), np.round(score, DIGITS) + 0.0


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def _add(best: Best, requests: Requests, rows: pa.Table) -> None:
    """The messages of ``rows`` (ids, ``keys`` and maybe ``weights``) against all requests."""
    keys = _chunk(rows.column("keys"))
    lengths = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
    message = np.repeat(np.arange(len(rows)), lengths)
    own = _chunk(rows.column("weights")).flatten().to_numpy() if "weights" in rows.column_names else None
    for pairs in requests.scores(message, keys.flatten(), own):
        best.take_pairs(rows, *pairs)


def listed(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """``(chat_id, seq, keys[, weights])`` from one row per message and key."""
    cells = [F.col(key).alias("key"), *([F.col(weight).alias("w")] if weight else [])]
    lists = rows.groupBy(*IDS).agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("c"))
    weights = [F.transform("c", lambda c: c["w"]).alias("weights")] if weight else []
    return lists.select(*IDS, F.transform("c", lambda c: c["key"]).alias("keys"), *weights)


def merged(lists: DataFrame) -> DataFrame:
    """``lists`` with the rows of an id that several have put together, as ``listed`` does it.

    Only the ids are shuffled, and the rows of such ids.
    """
    more = [c for c in ("keys", "weights") if c in lists.columns]
    lists = lists.select(*IDS, *more)
    twice = stored(lists.groupBy(*IDS).count().where("count > 1").select(*IDS))
    if twice.isEmpty():
        return lists
    twice = F.broadcast(twice) if fits(twice) else twice
    same = lists["chat_id"].eqNullSafe(twice["chat_id"]) & lists["seq"].eqNullSafe(twice["seq"])
    cells = lists.join(twice, same, "left_semi").select(*IDS, F.inline(F.arrays_zip(*more)))
    return lists.join(twice, same, "left_anti").unionByName(listed(cells, "keys", "weights" if "weights" in more else None))


def best_messages(messages: DataFrame, requests: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """The best ``k`` messages per task for every request, by the sum of products of shared keys.

    ``messages`` is ``(chat_id, seq, keys[, weights])``, ``requests`` a cheap or stored
    ``(query_id, key, weight)``. Only pairs that share a key are ever scored. One block of requests
    goes to the tasks; more stay a table, and blocks of requests meet blocks of messages by key, so
    the driver never holds them. Scores must exceed ``floor``.
    """
    asked = requests.select("query_id", "key", "weight").where("key IS NOT NULL AND weight IS NOT NULL")
    columns = [*IDS, "keys", *(["weights"] if "weights" in messages.columns else [])]
    rows = messages.select(columns)
    head = asked.limit(BLOCK_WEIGHTS + 1).toArrow()
    if not len(head):
        return messages.sparkSession.createDataFrame([], HITS)
    if len(head) > BLOCK_WEIGHTS:
        return _grid(rows, asked, k, floor)
    shared = messages.sparkSession.sparkContext.broadcast(Requests.of(head))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value.names, k, floor, IDS)
        for batch in batches:
            _add(best, shared.value, pa.Table.from_batches([batch]))
        yield from best.batches()

    return rows.mapInArrow(scan, HITS)


def _grid(rows: DataFrame, asked: DataFrame, k: int, floor: float) -> DataFrame:
    """``best_messages`` for every pair of a block of requests and a block of messages."""
    cells = F.collect_list(F.struct("key", "weight"))
    lists = stored(asked.groupBy("query_id").agg(cells.alias("cells")))
    rows = stored(rows)
    tall = max(1, ceil(lists.agg(F.sum(F.size("cells"))).first()[0] / (GRID * BLOCK_WEIGHTS)))
    wide = max(1, ceil((rows.agg(F.sum(F.size("keys"))).first()[0] or 0) / BLOCK_KEYS))
    block = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A number of partitions given here is kept; merged by size, the pairs would end in few tasks.
    parts = min(tall * wide, 8 * rows.sparkSession.sparkContext.defaultParallelism)
    meeting = lambda df: df.repartition(parts, "_q", "_b").groupBy("_q", "_b")
    q = lists.withColumn("_q", block(["query_id"], tall)).select("*", every(wide).alias("_b"))
    m = rows.withColumn("_b", block(IDS, wide)).select("*", every(tall).alias("_q"))
    fields = pa.schema([("query_id", pa.string()), ("chat_id", pa.string()), ("seq", pa.int64()), ("score", pa.float64())])

    def meet(some: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(some) or not len(wanted):
            return fields.empty_table()
        cells = _chunk(wanted.column("cells"))
        query = _chunk(wanted.column("query_id")).take(pc.list_parent_indices(cells))
        flat = cells.flatten()
        requests = Requests(query, flat.field("key"), flat.field("weight").to_numpy())
        best = Best(requests.names, k, floor, IDS)
        _add(best, requests, some.select([*IDS, *(c for c in ("keys", "weights") if c in some.column_names)]))
        return pa.concat_tables([fields.empty_table(), *(pa.Table.from_batches([b]).cast(fields) for b in best.batches())])

    return meeting(m).cogroup(meeting(q)).applyInArrow(meet, HITS)
