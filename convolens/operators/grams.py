"""Codes of word n-grams: counting those that can matter, and finding known ones, with numbers.

A word that is known has its place in a sorted list as its code. An n-gram that is known has as its
code the place of ``code of its first n - 1 words * number of words + code of its last word`` among
the sorted numbers of its length. So a task needs no n-gram as a string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tokens that a task codes at a time; a longer text is coded by itself.
STEP_TOKENS = 1_000_000
# What a token and its space have in bytes, about.
TOKEN_BYTES = 6
# What each byte of a text becomes: those of words (ASCII letters, digits, underscore and all of other
# characters) stay, the rest are spaces.
_PLAIN = bytes(b if b >= 128 or b == 95 or chr(b).isalnum() else 32 for b in range(256))
# Bytes of the character that a byte begins.
_CHAR_BYTES = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``text.tokens`` of texts that have no characters but those of words and ASCII: all tokens, and the row of each."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.array([], np.int64)
    plain = bytearray(texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(_PLAIN))
    data, ends = np.frombuffer(plain, np.uint8), ends - ends[0]
    inside = data != 32
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = inside[heads]  # no word goes on into the next row
    last[:-1] &= ~inside[1:] | begins[1:]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(last) + 1 - start
    long = size > _CHAR_BYTES[data[start]]
    for i in range(4):  # words of one character go
        data[start[~long & (size > i)] + i] = 32
    start, size = start[long], size[long]
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    flat = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(plain.translate(None, b" ")))
    return flat, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends)))


class Grams:
    """Known words and, per further length, the sorted numbers of the known n-grams."""

    def __init__(self, words: pa.Array, levels: Sequence[np.ndarray] = ()):
        self.words, self.levels = words, list(levels)

    def codes(self, flat: pa.Array, row: np.ndarray, longest: int) -> list[np.ndarray]:
        """For n-grams of 1 to ``longest`` words, the code of the one that starts at each token, -1 for unknown ones."""
        found = [self._words(flat)]
        for n in range(2, longest + 1):
            found.append(_places(self.levels[n - 2], self._numbers(found[-1], found[0], row, n)))
        return found

    def numbers(self, flat: pa.Array, row: np.ndarray, length: int) -> np.ndarray:
        """The number of the n-gram that starts at each token, -1 unless both n-grams one word shorter in it are known."""
        found = self.codes(flat, row, length - 1)
        number = self._numbers(found[-1], found[0], row, length)
        number[:-1][found[-1][1:] < 0] = -1
        return number

    def _words(self, flat: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy().astype(np.int64)

    def _numbers(self, code: np.ndarray, word: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(code), -1, dtype=np.int64)
        m = len(code) - n + 1
        if m > 0:
            good = (code[:m] >= 0) & (word[n - 1 :] >= 0) & (row[:m] == row[n - 1 :])
            out[:m][good] = code[:m][good] * len(self.words) + word[n - 1 :][good]
        return out

    def terms(self, length: int, code: np.ndarray) -> pa.Array:
        """The n-grams of some codes as strings."""
        if length == 1:
            return self.words.take(pa.array(code))
        return self.named(length, self.levels[length - 2][code])

    def named(self, length: int, number: np.ndarray) -> pa.Array:
        """The n-grams of some numbers as strings."""
        head, last = np.divmod(number, max(1, len(self.words)))
        return pc.binary_join_element_wise(self.terms(length - 1, head), self.words.take(pa.array(last)), " ")


def _places(known: np.ndarray, number: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(number), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, number), len(known) - 1)
    return np.where(known[at] == number, at, -1)


class Known:
    """Terms of a vocabulary, of several lengths, with a value each; of equal terms the first counts."""

    def __init__(self, terms: Sequence[str], values: np.ndarray):
        first: dict[str, int] = {}
        for i, term in enumerate(terms):
            if term is not None:
                first.setdefault(term, i)
        order = sorted(first, key=lambda t: t.encode())
        self.terms = pa.array(order, pa.string())
        self.values = np.asarray(values, dtype=np.float64)[[first[t] for t in order]]
        parts = [t.split(" ") for t in order]
        words = sorted({w for p in parts for w in p})
        place, levels, self.term_of = {w: i for i, w in enumerate(words)}, [], []
        head = [place[p[0]] for p in parts]
        for n in range(1, max(map(len, parts), default=0) + 1):
            if n > 1:
                number = {i: head[i] * len(words) + place[p[n - 1]] for i, p in enumerate(parts) if len(p) >= n}
                level = np.unique(np.fromiter(number.values(), np.int64, len(number)))
                levels.append(level)
                for i, x in number.items():
                    head[i] = int(np.searchsorted(level, x))
            term_of = np.full(len(levels[-1]) if n > 1 else len(words), -1, dtype=np.int64)
            for i, p in enumerate(parts):
                if len(p) == n:
                    term_of[head[i]] = i
            self.term_of.append(term_of)
        self.grams = Grams(pa.array(words, pa.string()), levels)

    def counted(self, texts: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, tf)`` of the known terms with ``low`` to ``high`` words, by row, then term."""
        flat, row = split(texts)
        found = []
        high = min(high, len(self.term_of))
        for n, code in enumerate(self.grams.codes(flat, row, high) if high else [], 1):
            if n < low:
                continue
            at = np.flatnonzero(code >= 0)
            term = self.term_of[n - 1][code[at]]
            at, term = at[term >= 0], term[term >= 0]
            found.append(row[at].astype(np.int64) * len(self.terms) + term)
        both, tf = np.unique(np.concatenate(found) if found else np.array([], np.int64), return_counts=True)
        row, term = np.divmod(both, max(1, len(self.terms)))
        return row, term, tf.astype(np.int64)


def steps(batches: Iterator[pa.RecordBatch], column: str, size: Callable[[pa.Array], pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut and put together to about ``STEP_TOKENS`` tokens, so that a task's memory is bounded.

    ``size`` gives the tokens of each row, by default those of a text of its length.
    """
    held, tokens = [], 0
    for batch in batches:
        cells = batch.column(column)
        sizes = pc.divide(pc.binary_length(cells), TOKEN_BYTES) if size is None else size(cells)
        sizes = np.maximum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64), 1)  # rows count too
        upto = tokens + np.cumsum(sizes)
        part = upto // STEP_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield _joined(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        if batch.num_rows:
            tokens = int(upto[-1])
        if tokens >= STEP_TOKENS:
            yield _joined(held)
            held, tokens = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def order_of(code: np.ndarray) -> np.ndarray:
    """The places of codes that are not negative in ascending order, equal ones as they stand."""
    n = max(1, len(code))
    return np.sort(code.astype(np.int64) * n + np.arange(len(code))) % n


def tallied(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, rows that have it, occurrences)`` of codes that are not negative."""
    good = code >= 0
    row, code = row[good].astype(np.int64), code[good].astype(np.int64)
    if not len(code):
        return code, code, code
    rows = int(row.max()) + 1
    if int(code.max()) < (1 << 62) // rows:  # one number for both sorts faster
        both = np.sort(code * rows + row)
        code, new = both // rows, np.r_[True, both[1:] != both[:-1]]
        fresh = np.r_[True, code[1:] != code[:-1]]
    else:
        order = np.lexsort((row, code))
        row, code = row[order], code[order]
        fresh = np.r_[True, code[1:] != code[:-1]]
        new = fresh | np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(fresh)
    return code[first], np.add.reduceat(new.astype(np.int64), first), np.diff(np.r_[first, len(code)])
