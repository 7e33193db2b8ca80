"""Periodic runs of words, found by longest common extensions over a difference cover.

A run is a stretch of words that repeats with a smallest period, at least twice, and that no
neighbouring word extends. Texts of a batch stand in one array of word numbers, a unique end mark
after each.

* Only suffixes at positions of a difference cover modulo ``MODULUS`` are sorted: first by their
  next ``MODULUS`` words, then by doubling (a sampled position plus a multiple of the modulus is
  sampled again). Neighbours in that order get the length of their common prefix, and a sparse
  table answers minima.
* For any two positions there is a shift below the modulus that makes both of them sampled. A common
  extension compares the words up to that shift and then asks the table.
* A run of period ``p`` covers two neighbouring points of the grid 0, p, 2p, ..., so the extensions
  of those pairs to the left and to the right give every run; there are n/1 + n/2 + ... pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import slices

# A difference cover: every number below the modulus is a difference of two members. Fixed values.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
# Words of a run at least.
LEAST = 12
# Grid pairs that a task looks at together; a single text may have more and is cut by periods.
PAIRS = 2_000_000

_SAMPLED = np.isin(np.arange(MODULUS), COVER)
# The shift that brings two residues onto the cover together.
_SHIFT = np.array(
    [
        [next(d for d in range(MODULUS) if _SAMPLED[(a + d) % MODULUS] and _SAMPLED[(b + d) % MODULUS]) for b in range(MODULUS)]
        for a in range(MODULUS)
    ]
)


def _firsts(changed: np.ndarray) -> np.ndarray:
    """For each place the last place up to it at which something has changed."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


class Extensions:
    """Longest common prefixes of two suffixes of ``words``, where they lie in texts of one owner.

    Every text must end with a number that occurs nowhere else.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(MODULUS, words.dtype)])
        self.at = np.flatnonzero(_SAMPLED[np.arange(self.n) % MODULUS])
        self.place = np.full(self.n, -1, dtype=np.int64)
        self.place[self.at] = np.arange(len(self.at))
        levels = self._sort(owner)
        self.rank = levels[-1]
        self.minima = self._sparse(self._prefixes(levels, owner))

    def _sort(self, owner: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first ``MODULUS``, twice, four times ... as many words."""
        bits = max(1, int(self.words.max()).bit_length())
        per = max(1, 63 // bits)
        keys = []
        for start in range(0, MODULUS, per):
            key = np.zeros(len(self.at), dtype=np.int64)
            for t in range(start, min(start + per, MODULUS)):
                key = (key << bits) | self.words[self.at + t]
            keys.append(key)
        order = np.lexsort([*keys[::-1], owner[self.at]])
        changed = np.zeros(len(order), dtype=bool)
        changed[:1] = True
        for key in [owner[self.at], *keys]:
            sorted_key = key[order]
            changed[1:] |= sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = _firsts(changed)
        levels, step = [rank], MODULUS
        while len(tied := np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)):
            after = self.at[tied] + step
            following = np.where(after < self.n, rank[self.place[np.minimum(after, self.n - 1)]], -1)
            order = np.lexsort((following, rank[tied]))
            members, old, new = tied[order], rank[tied][order], following[order]
            group = np.r_[True, old[1:] != old[:-1]]
            part = group | np.r_[True, new[1:] != new[:-1]]
            rank = rank.copy()
            rank[members] = old + _firsts(part) - _firsts(group)
            levels.append(rank)
            step *= 2
        return levels

    def _prefixes(self, levels: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in the order; 0 between texts."""
        order = np.argsort(self.rank)
        a, b = self.at[order[:-1]], self.at[order[1:]]
        common = np.zeros(len(a), dtype=np.int64)
        pairs = np.flatnonzero(owner[a] == owner[b])
        for k in range(len(levels) - 1, -1, -1):
            x, y = a[pairs] + common[pairs], b[pairs] + common[pairs]
            inside = np.maximum(x, y) < self.n
            x, y = (self.place[np.minimum(p, self.n - 1)] for p in (x, y))
            common[pairs[inside & (levels[k][x] == levels[k][y])]] += MODULUS << k
        x, y = a[pairs] + common[pairs], b[pairs] + common[pairs]
        common[pairs] += self._compare(x, y, np.full(len(pairs), MODULUS))
        return common

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, up to ``most`` of them."""
        equal = np.zeros(len(i), dtype=np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            done = equal[active]
            same = self.words[i[active] + done] == self.words[j[active] + done]
            active = active[same]
            equal[active] += 1
            active = active[equal[active] < most[active]]
        return equal

    @staticmethod
    def _sparse(values: np.ndarray) -> np.ndarray:
        """Row k holds minima of 2**k neighbours."""
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            last, half = rows[-1], 1 << (len(rows) - 1)
            row = last.copy()
            row[:-half] = np.minimum(last[:-half], last[half:])
            rows.append(row)
        return np.array(rows)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``i`` and at ``j``; ``i != j``."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        length = self._compare(i, j, shift)
        met = np.flatnonzero(length == shift)
        a, b = (self.rank[self.place[p[met] + shift[met]]] for p in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp(high - low)[1] - 1  # the greatest power of two within the distance
        length[met] += np.minimum(self.minima[k, low], self.minima[k, high - (1 << k)])
        return length


class _Text:
    """The texts of a group in one array: an end mark before the first text and after each."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(np.r_[1, self.sizes[:-1] + 1]).astype(np.int64)
        top = 1 + max((int(t.max()) for t in texts if len(t)), default=0)
        ends = np.arange(top, top + len(texts) + 1, dtype=np.int64)
        self.words = np.concatenate([ends[:1], *[p for t, e in zip(texts, ends[1:]) for p in (t, [e])]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.owner = np.r_[0, self.owner]


def _grid(sizes: np.ndarray, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, period, place)`` of all grid pairs, in pieces of about ``pairs``."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (sizes[text] - 1) // period
    ends = np.cumsum(points)
    start = 0
    while start < len(text):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + pairs, side="right")))
        n = points[start:stop]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[start:stop], n)
        yield np.repeat(text[start:stop], n), p, k * p
        start = stop


def _alike(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, count: int) -> np.ndarray:
    """Which pairs agree in ``count`` words in the direction of ``step``."""
    left = np.arange(len(i))
    for t in range(count):
        left = left[words[i[left] + t * step] == words[j[left] + t * step]]
    return left


def _group_runs(texts: list[np.ndarray], least: int, pairs: int) -> np.ndarray:
    """Rows ``(text, start, end, period)`` of all runs of the texts, by text, start and period."""
    whole = _Text(texts)
    # Both extensions together reach half of the least length, so one of them half of that.
    few = max(1, -(-(-(-least // 2)) // 2))
    ready: dict[bytes, tuple] = {}
    found = [np.zeros((0, 4), dtype=np.int64)]
    for text, p, k in _grid(whole.sizes, pairs):
        i = whole.starts[text] + k
        ahead = _alike(whole.words, i, i + p, 1, few)
        behind = _alike(whole.words, i - 1, i + p - 1, -1, few)
        chosen = np.union1d(ahead, behind)
        if not len(chosen):
            continue
        text, p, k = text[chosen], p[chosen], k[chosen]
        members = np.unique(text)
        if (key := members.tobytes()) not in ready:
            part = _Text([texts[m] for m in members])
            ready = {key: (part, Extensions(part.words, part.owner), Extensions(part.words[::-1], part.owner[::-1]))}
        part, forward, backward = ready[key]
        i = part.starts[np.searchsorted(members, text)] + k
        right = forward.common(i, i + p)
        last = len(part.words) - 1
        left = backward.common(last - (i - 1), last - (i + p - 1))
        length = left + right + p
        good = length >= np.maximum(least, 2 * p)
        rows = np.stack([text, k - left, k - left + length, p], axis=1)[good]
        found.append(_smallest(rows))
    rows = _smallest(np.concatenate(found))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row per stretch, the one of the smallest period."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]] if len(rows) else rows


def runs_of(texts: list[list[bytes]], least: int = LEAST, pairs: int = PAIRS) -> list[np.ndarray]:
    """Per text the rows ``(start, length, period)`` of its runs, by start and period."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    out, group, weight = [], [], 0

    def flush() -> None:
        rows = _group_runs(group, least, pairs)
        for part in np.split(rows, np.searchsorted(rows[:, 0], np.arange(1, len(group)))):
            out.append(np.stack([part[:, 1], part[:, 2] - part[:, 1], part[:, 3]], axis=1))
        group.clear()
        numbers.clear()

    for words in texts:
        # n/1 + n/2 + ... pairs
        own = len(words) * max(1, len(words).bit_length())
        if group and weight + own > pairs:
            flush()
            weight = 0
        group.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        weight += own
    if group:
        flush()
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, or in the first period of every run that has them."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _columns(texts: list[bytes | None], least: int) -> list[pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    words = [(t or b"").split() for t in texts]  # bytes split at the six ASCII blanks alone
    found = runs_of(words, least)
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    short = [b" ".join(compress(w, kept_words(len(w), r)) if len(r) else w) for w, r in zip(words, found)]
    return [
        pa.array(list(map(len, words)), pa.int64()),
        pa.ListArray.from_arrays(pa.array(ends), structs),
        pa.array(short, pa.binary()).cast(pa.string()),
    ]


RUNS = "array<struct<start: long, length: long, period: long>>"
ADDED = ("n_words", "runs", "collapsed")


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, drop_text: bool = False) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to every row.

    Words are what blanks (U+0020, U+0009 to U+000D) separate, numbered from 0. ``runs`` lists
    ``(start, length, period)`` by start and period, all of at least ``least`` words and two
    periods. ``collapsed`` is the text without the words that repeat a run's first period, words
    joined by one blank.

    A null or empty text has no words, no runs and an empty collapsed text. Every row gives a row,
    repeated ones too; the other columns pass through, except that columns named like those added
    are replaced. Rows are worked on alone, in tasks, without a shuffle; a text needs memory in
    proportion to its own words. An empty table gives an empty one.
    """
    plain = docs.drop(*(c for c in ADDED if c != text))
    out = [f for f in plain.schema if not (drop_text and f.name == text)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            rest = batch.drop_columns([text]) if drop_text else batch
            for name, column in zip(ADDED, _columns(texts, least)):
                rest = rest.append_column(name, column)
            yield rest

    return plain.mapInArrow(run, f"{kinds}, n_words long, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Replace ``runs`` and ``collapsed`` of ``find_runs`` by counts, the longest run and hashes."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The greatest length, then the smallest start and period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = found.withColumn("_best", longest)
    start, length, period = -F.col("_best.col2"), F.col("_best.length"), -F.col("_best.col3")
    return best.withColumns(
        {
            "n_runs": F.size("runs").cast("long"),
            "start": start,
            "length": length,
            "period": period,
            "exponent_milli": F.floor(1000 * length / period),
            "runs_sha256": F.sha2(F.array_join(lines, "").cast("binary"), 256),
            "collapsed_sha256": F.sha2(F.col("collapsed").cast("binary"), 256),
        }
    ).drop("_best", "runs", "collapsed")
