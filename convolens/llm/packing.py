"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths take few values, so everything is decided on the histogram of lengths (at most ``capacity``
rows); documents only meet the decision through their rank in the order of lengths.

1. Large lengths, in descending order, are cut into groups of equal cardinality; each counts as
   long as its group's longest. Few sizes remain.
2. Configurations of those sizes are optimised as a linear programme by column generation; each is
   used the whole number of times below its optimum.
3. Actual documents take the places of their group. What rounding up has wasted is room again.
4. Large documents left over and all small ones, in descending order, go into the sequence with
   the least sufficient room, or open a new one.

Every step works on runs (so many sequences with equal room), never on single sequences, so the
driver's work depends on the capacity and not on the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import RESERVED, kept, map_batches, numbered, slices
from convolens.llm.tokens import vocabulary, word_ids

CAPACITY = 4096
GROUPS = 12
SMALL = 8  # lengths of at most capacity / SMALL are small
END = np.array([1], dtype="<u4").tobytes()

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, position: Column | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: token sequences of at most ``capacity``.

    A document is its ids and an end mark; null texts are empty, so they are the mark alone. With a
    ``position`` its value, a double, comes as a last column.
    """
    path = path or vocabulary("word_bpe_49k.json")
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    extra = [] if position is None else [position.cast("double").alias("position")]
    ordered = position is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in slices(batches):
            out: list[tuple] = []
            of: list[int] = []
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                ids = encoder.ids(text.as_py() or "") + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    of.append(i)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            pieces = pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pieces.append_column("position", batch.column("position").take(pa.array(of, pa.int64()))) if ordered else pieces

    return docs.select(*wanted, *extra).mapInArrow(run, _PIECES + ", position double" * ordered)


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity of greatest total value (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fit = np.flatnonzero(sizes <= room)
        total = best[room - sizes[fit]] + value[fit]
        top = int(total.argmax())
        if total[top] > best[room - 1] + 1e-12:
            best[room], last[room] = total[top], fit[top]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[last[room]] += 1
        room -= int(sizes[last[room]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of ``sizes`` and how often to use each, rounded down from the optimum.

    The simplex keeps one basic pattern per size; prices of sizes come from the basis, and the
    knapsack finds the pattern that gains most, until none gains.
    """
    k = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    amount = demand / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        pattern = _best_pattern(sizes, np.maximum(price, 0), capacity)
        if pattern @ price <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, pattern)
        limits = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(limits.argmin())
        if not np.isfinite(limits[leave]):
            break
        amount = amount - limits[leave] * change
        amount[leave] = limits[leave]
        amount = np.maximum(amount, 0)
        basis[:, leave] = pattern
    left, out = demand.astype(np.int64).copy(), []
    for j in range(k):
        use = basis[:, j] > 0
        times = int(min(np.floor(amount[j] + 1e-9), (left[use] // basis[use, j]).min()))
        if times > 0:
            left -= (basis[:, j] * times).astype(np.int64)
            out.append((basis[:, j].astype(np.int64), times))
    return out


class Plan:
    """Where each rank goes: segments ``(first rank, end rank, first sequence, ranks per sequence)``."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int, small: int):
        """``lengths`` in descending order; rank 0 is the longest piece."""
        self.capacity, self.segments, self.sequences = capacity, [], 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences
        self.free = np.zeros(capacity + 1, dtype=bool)
        self.lengths, self.ends = lengths, np.cumsum(counts)
        self.sums = np.concatenate([[0], np.cumsum(lengths * counts)])
        n = int(self.ends[-1]) if len(counts) else 0
        full = int(counts[lengths == capacity].sum())
        big = int(counts[lengths > capacity // small].sum())
        if full:
            self._put(0, full, self._open(full), 1)
        for start, end in self._configured(full, big, groups):
            self._best_fit(start, end)
        self._best_fit(big, n)

    def _open(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def _put(self, start: int, end: int, sequence: int, per: int) -> None:
        if end > start:
            self.segments.append((start, end, sequence, per))

    def _add(self, room: int, first: int, n: int) -> None:
        if n > 0 and room > 0:
            self.room[room].append((first, n))
            self.free[room] = True

    def _sum(self, rank: int) -> int:
        """Total length of all ranks below ``rank``."""
        i = int(np.searchsorted(self.ends, rank))
        if i >= len(self.ends):
            return int(self.sums[-1])
        before = int(self.ends[i - 1]) if i else 0
        return int(self.sums[i]) + (rank - before) * int(self.lengths[i])

    def _configured(self, start: int, end: int, groups: int) -> list[tuple[int, int]]:
        """Fill sequences by configurations; the ranks left over, in order."""
        if end <= start:
            return []
        cuts = np.unique(np.linspace(start, end, min(groups, end - start) + 1).astype(np.int64))
        sizes = self.lengths[np.searchsorted(self.ends, cuts[:-1], side="right")].astype(np.int64)
        at = cuts[:-1].copy()
        for pattern, times in configurations(sizes, np.diff(cuts).astype(float), self.capacity):
            first, members = self._open(times), []
            for j in np.flatnonzero(pattern):
                per = int(pattern[j])
                members.append((int(at[j]), per))
                self._put(int(at[j]), int(at[j]) + per * times, first, per)
                at[j] += per * times
            # Room changes only where a length changes among the members.
            breaks = {0, times}
            for rank, per in members:
                lo, hi = np.searchsorted(self.ends, [rank, rank + per * times])
                for e in self.ends[lo:hi]:
                    t = (int(e) - rank) // per
                    breaks.update(x for x in (t, t + 1) if 0 <= x <= times)
            marks = sorted(breaks)
            for a, b in zip(marks, marks[1:]):
                used = sum(self._sum(r + p * (a + 1)) - self._sum(r + p * a) for r, p in members)
                self._add(self.capacity - used, first + a, b - a)
        return [(int(a), int(b)) for a, b in zip(at, cuts[1:]) if b > a]

    def _best_fit(self, start: int, end: int) -> None:
        """Place ranks in descending order of length, each where it leaves least room."""
        i = int(np.searchsorted(self.ends, start, side="right"))
        while start < end:
            length, stop = int(self.lengths[i]), min(end, int(self.ends[i]))
            while start < stop:
                fit = np.flatnonzero(self.free[length:])
                left = stop - start
                if not len(fit):
                    per = self.capacity // length
                    n, rest = divmod(left, per)
                    n = n or 1
                    take = min(left, n * per)
                    first = self._open(n)
                    self._put(start, start + take, first, per)
                    self._add(self.capacity - (per if take == n * per else take) * length, first, n)
                    start += take
                    continue
                room = length + int(fit[0])
                first, n = self.room[room].pop()
                per = min(room // length, left)
                use = min(n, left // per)
                if use < n:
                    self.room[room].append((first + use, n - use))
                self.free[room] = bool(self.room[room])
                self._put(start, start + use * per, first, per)
                self._add(room - per * length, first, use)
                start += use * per
            i += 1

    def sequence(self, rank: np.ndarray) -> np.ndarray:
        start, _, first, per = self.table()
        i = np.searchsorted(start, rank, side="right") - 1
        return first[i] + (rank - start[i]) // per[i]

    def table(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(sorted(self.segments), dtype=np.int64).reshape(-1, 4).T)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Places in a sequence have no gaps. Equal pieces are interchangeable; an empty table gives an
    empty one. Columns with the names added here, or with helper names (``RESERVED``), are dropped.
    """
    plain = pieces.drop("sequence_id", "offset", "_rank", *RESERVED)
    # Pieces of one length stand by position, if they have one, so that neighbours come together.
    first = [c for c in plain.columns if c == "position"]
    order = [F.col("length").desc(), *first, *[c for c in plain.columns if c not in ("length", *first)]]
    ranked = numbered(plain, "_rank", *order)
    histogram = ranked.groupBy("length").count().orderBy(F.col("length").desc()).collect()
    if histogram and not 1 <= histogram[-1][0] <= histogram[0][0] <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths, counts = (np.array(c, dtype=np.int64) for c in (zip(*histogram) if histogram else ([], [])))
    start, _, first, per = Plan(lengths, counts, capacity, groups, small).table()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column("_rank").to_numpy()
        i = np.searchsorted(start, rank, side="right") - 1
        sequence = first[i] + (rank - start[i]) // per[i]
        return batch.append_column("sequence_id", pa.array(sequence))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = map_batches(ranked, step, f"{fields}, sequence_id long", rows=100_000)
    # A sequence holds at most ``capacity`` pieces.
    earlier = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return placed.select(*plain.columns, "sequence_id", offset)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenize ``docs`` (``doc_id``, ``text``) and pack their pieces."""
    return pack(kept(tokenized(docs, path, capacity), "pieces"), capacity, **options)


def in_training_order(packed: DataFrame) -> DataFrame:
    """Add ``sequence_order``, from 0: sequences by the mean ``position`` of their tokens, those without one last."""
    weight = F.when(F.col("position").isNotNull(), F.col("length"))
    mean = (F.sum(F.col("position") * F.col("length")) / F.sum(weight)).alias("mean")
    sequences = packed.groupBy("sequence_id").agg(mean)
    placed = numbered(sequences, "sequence_order", F.col("mean").asc_nulls_last(), "sequence_id")
    return packed.join(placed.drop("mean"), "sequence_id").select(*packed.columns, "sequence_order")
