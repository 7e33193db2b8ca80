"""The best rows per query among those a task has seen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


class Best:
    """The best ``k`` rows per query so far, by score, then by ids."""

    def __init__(self, names: Sequence[str] | pa.Array, k: int, floor: float | None, ids: list[str]):
        self.names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
        self.k, self.ids = k, ids
        # Score a row needs to matter: above the floor, later at least the k-th best so far.
        self.needed = np.full(len(self.names), -np.inf if floor is None else np.nextafter(floor, np.inf))
        self.kept: pa.Table | None = None

    def take(self, ids: pa.Table, scores: np.ndarray) -> None:
        """Rows with their scores for every query."""
        if len(scores) > self.k:
            # Ties with the k-th score stay; the sort below settles them by id.
            kth = np.partition(scores, -self.k, axis=0)[-self.k]
            enough = scores >= np.maximum(self.needed, kth)
        else:
            enough = scores >= self.needed
        row, query = np.nonzero(enough)
        self._merge(ids, row, query, scores[row, query])

    def take_pairs(self, ids: pa.Table, row: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some pairs of a row and a query; a pair occurs once in all calls."""
        good = np.flatnonzero(scores >= self.needed[query])
        good = good[np.lexsort((-scores[good], query[good]))]
        row, query, scores = row[good], query[good], scores[good]
        first, end = np.searchsorted(query, query), np.searchsorted(query, query, side="right")
        # Ties with the k-th score stay here too.
        enough = scores >= scores[np.minimum(first + (self.k - 1), end - 1)]
        self._merge(ids, row[enough], query[enough], scores[enough])

    def _merge(self, ids: pa.Table, row: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        if not len(row):
            return
        found = ids.select(self.ids).take(pa.array(row)).append_column("score", pa.array(scores))
        found = found.append_column("query", pa.array(query, pa.int64()))
        if self.kept is not None:
            found = pa.concat_tables([self.kept, found])
        order = [("query", "ascending"), ("score", "descending"), *[(c, "ascending") for c in self.ids]]
        found = found.sort_by(order)
        query = found.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.kept = found.filter(pa.array(place < self.k))
        last = np.flatnonzero(place == self.k - 1)
        self.needed[query[last]] = found.column("score").to_numpy()[last]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.kept is None or not len(self.kept):
            return
        named = self.names.take(self.kept.column("query").combine_chunks())
        out = self.kept.drop_columns(["query"]).add_column(0, "query_id", named)
        yield from out.combine_chunks().to_batches()
