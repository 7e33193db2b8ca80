"""A character trigram model of words, counted over a whole corpus, and the channel that disguises
them: a Viterbi decoder restores leetspeak, spaced and stretched writing."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import slices

EDGE = " "
# What may stand for a letter.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
SEPARATORS = " .-_*~/\\,:;'`\""
# Costs of the channel, as logarithms: a lookalike, a dropped separator, a repeat taken away,
# and a blank meant as a blank.
SWAPPED, DROPPED, SQUEEZED, BLANK = -0.5, -0.1, -0.1, -1.0
OTHER = chr(1)


# Symbols of the model: word end, any other letter, a-z, and the small letters of Latin-1.
SYMBOLS = [EDGE, OTHER, *map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
_AT = {c: i for i, c in enumerate(SYMBOLS)}
# Code points to symbols; those beyond the table are letters of some other script, or edges.
_TABLE = np.array(
    [_AT.get(chr(c).lower(), _AT[OTHER] if chr(c).isalpha() else 0) for c in range(0x3000)] + [1], dtype=np.int64
)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(gram, n)``: letter trigrams of all words of all documents, word ends written as blanks.

    Words are runs of letters, lower-cased; every character of every text is read. Letters beyond
    Latin-1 share one symbol, so there are at most ``len(SYMBOLS) ** 3`` trigrams. Each task sends
    its own counts and never text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SYMBOLS) ** 3, dtype=np.int64)
        for batch in slices(batches):
            values = [t for t in batch.column("text").to_pylist() if t]
            for start in range(0, len(values), 64):
                total += count_trigrams(" ".join(values[start : start + 64]))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def count_trigrams(text: str) -> np.ndarray:
    """How often each trigram occurs around a letter of one text."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    n = len(SYMBOLS)
    middle = np.flatnonzero(code[1:-1])
    gram = (code[middle] * n + code[middle + 1]) * n + code[middle + 2]
    return np.bincount(gram, minlength=n**3)


def gram_text(gram: int) -> str:
    n = len(SYMBOLS)
    return SYMBOLS[gram // (n * n)] + SYMBOLS[gram // n % n] + SYMBOLS[gram % n]


class CharModel:
    """Trigram probabilities, interpolated with bigrams and single letters."""

    def __init__(self, grams: dict[int, int]):
        grams = {gram_text(g): n for g, n in grams.items()}
        self.three, self.two, self.one = Counter(grams), Counter(), Counter()
        context3, context2 = Counter(), Counter()
        for g, n in grams.items():
            # A trigram is counted at its middle letter; that letter's own pair and single count.
            self.two[g[:2]] += n
            self.one[g[1]] += n
            context3[g[:2]] += n
            if g[2] == EDGE:
                self.two[g[1:]] += n
                self.one[EDGE] += n
        for pair, n in self.two.items():
            context2[pair[0]] += n
        self.context3, self.context2 = context3, context2
        self.total = max(1, sum(self.one.values()))
        self.letters = len(self.one) + 1
        self._memory: dict[str, float] = {}

    def log(self, before: str, letter: str) -> float:
        """Log probability of ``letter`` after two characters."""
        key = before + letter
        if key not in self._memory:
            p1 = (self.one[letter] + 0.5) / (self.total + 0.5 * self.letters)
            p2 = (self.two[before[1] + letter] + 2 * p1) / (self.context2[before[1]] + 2)
            p3 = (self.three[key] + 4 * p2) / (self.context3[before] + 4)
            self._memory[key] = float(np.log(p3))
        return self._memory[key]


# What makes a span worth decoding; everything else is passed on as it is.
LOOKS = "".join(map(re.escape, LOOKALIKES))
SIGNS = "".join(re.escape(c) for c in LOOKALIKES if not c.isdigit())
SILENT = "".join(map(re.escape, SEPARATORS))
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:[{SILENT}]{{1,3}}(?:[^\W_]|[{SIGNS}])(?![^\W_])){{2,}}")
# Two characters by themselves, one after the other, as every run of SPACED has them: cheaper to look for.
ALONE = rf"[{SILENT}]{{1,3}}(?:[^\W_]|[{SIGNS}])"
NEAR = re.compile(rf"{ALONE}{ALONE}(?![^\W_])")
SUSPECT = re.compile(
    rf"[^\W\d_][{LOOKS}]+[^\W\d_]|^[{LOOKS}]+[^\W\d_]{{2}}|[^\W\d_][~_]+[^\W\d_]|([^\W\d_])\1\1"
)


# What may have another reading: a lookalike, an inner separator or a repeated letter, beside a letter.
OPEN = re.compile(rf"[{LOOKS}]|[^\W_][{SILENT}]+[^\W_]|([^\W_])\1")
LETTER = re.compile(r"[^\W\d_]")
REPEAT = re.compile(r"(.)\1")
TWICE = re.compile(r"([^\W_])\1")
_SILENCED = str.maketrans("", "", SEPARATORS)


def decode(model: CharModel, span: str, squeeze: bool = True) -> str:
    """The likeliest words behind ``span``.

    The lattice has a state per pair of last letters. A character may stand for itself (letters
    only), for what it looks like, for nothing (separators, or a repeat of the character before),
    and a blank for a blank; without ``squeeze`` repeats stay. Ties go to the path found first, in the order of the readings.
    """
    start = EDGE * 2
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    previous = ""
    for ch in span.lower():
        readings = [(r, SWAPPED) for r in LOOKALIKES.get(ch, "")]
        if ch.isalpha():
            readings.insert(0, (ch, 0.0))
        silent = DROPPED if ch in SEPARATORS or not readings else SQUEEZED if squeeze and ch == previous else None
        following: dict[str, tuple[float, tuple | None]] = {}
        for before, (score, path) in states.items():
            options = [(before, score + silent, path)] if silent is not None else []
            if ch == " " and before != start:
                options.append((start, score + BLANK + model.log(before, EDGE), (path, EDGE)))
            for letter, cost in readings:
                known = letter if letter in _AT else OTHER
                options.append((before[1] + known, score + cost + model.log(before, known), (path, letter)))
            for state, total, way in options:
                if state not in following or total > following[state][0]:
                    following[state] = (total, way)
        states, previous = following, ch
    _, path = max(((s + model.log(b, EDGE), p) for b, (s, p) in states.items()), key=lambda e: e[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def may_differ(word: str) -> bool:
    """Whether a word has a sign or a repeat that could make it another one."""
    if word.isalpha():  # no sign at all
        return bool(TWICE.search(word))
    return bool(LETTER.search(word) and OPEN.search(word))


def _inner(span: str, spare) -> str:
    """A span without the signs at its ends, but for those in ``spare``."""
    start, end = 0, len(span)
    while start < end and not span[start].isalnum() and span[start] not in spare:
        start += 1
    while end > start and not span[end - 1].isalnum() and span[end - 1] not in spare:
        end -= 1
    return span[start:end]


def readings(model: CharModel, span: str) -> list[str]:
    """Decoded readings of a span: with the signs at its ends as letters or as signs, repeats taken away or meant."""
    out = {}
    for part in dict.fromkeys(_inner(span, spare) for spare in (LOOKALIKES, ())):
        if len(part) > 1 and (" " in part or OPEN.search(part)):
            out[decode(model, part)] = None
            # Of letters alone this would be the word as it stands.
            if not part.isalpha() and REPEAT.search(part.lower().translate(_SILENCED)):
                out[decode(model, part, squeeze=False)] = None
    return list(out)


# One letter of each group of letters that a lookalike can stand for; "1" and "|" are i or l.
_GROUPS = {"l": "i"}
WILD = "*"
_CLASS = {c: _GROUPS.get(r[0], r[0]) for c, r in LOOKALIKES.items() if c != WILD} | _GROUPS
_DOUBLE = re.compile(r"(.)\1+", re.DOTALL)


def skeleton(span: str) -> str | None:
    """What all readings of a span have in common: letters that lookalikes mix up are one letter, signs
    that can only be dropped are gone, and repeats are one. None if the span holds a wild card.

    Every word that ``decode`` reads in the span has a skeleton that is part of the span's, without
    blanks in the span all of it: a character is read as a letter of its class, or dropped as a sign
    or as a repeat.
    """
    if WILD in span:
        return None
    kept = [_CLASS.get(c, c) for c in span.lower() if c in _CLASS or c.isalpha()]
    return _DOUBLE.sub(r"\1", "".join(kept))


class Skeletons:
    """Whether a reading can be one of some terms (a term that ends with ``*`` is a beginning)."""

    def __init__(self, terms):
        shapes = [(skeleton(t.removesuffix("*")), t.endswith("*")) for t in terms]
        # A term with a wild card of its own has no skeleton; nothing is ruled out then.
        self.open = any(not shape for shape, _ in shapes)
        self.whole = {shape for shape, begins in shapes if not begins}
        self.starts = {shape for shape, begins in shapes if begins}
        self.lengths = sorted({len(s) for s in self.starts if s})
        parts = sorted({s for s in self.whole | self.starts if s}, key=len)
        self.inside = re.compile("|".join(map(re.escape, parts))) if parts else None

    def word(self, word: str) -> bool:
        """Whether a word without blanks may be read as a term."""
        for part in {_inner(word, LOOKALIKES), _inner(word, ())}:
            shape = skeleton(part)
            if self.open or shape is None or shape in self.whole:
                return True
            if any(shape[:n] in self.starts for n in self.lengths if n <= len(shape)):
                return True
        return False

    def run(self, run: str) -> bool:
        """Whether any word read in a run may be a term."""
        shape = skeleton(run)
        return self.open or shape is None or bool(self.inside and self.inside.search(shape))


class Restorer:
    """Restores whole texts word by word, remembering words met before."""

    MEMORY = 100_000

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def word(self, word: str) -> str:
        """A word as it was meant; ordinary words come back as they are."""
        if word not in self.known:
            if len(self.known) >= self.MEMORY:
                self.known.clear()
            self.known[word] = decode(self.model, word) if SUSPECT.search(word) else word
        return self.known[word]

    def all(self, word: str) -> list[str]:
        """The word as it stands and every decoded reading of it."""
        more = readings(self.model, word) if may_differ(word) else []
        return list(dict.fromkeys([word.lower(), *more]))

    def restore(self, text: str) -> str:
        joined = SPACED.sub(lambda m: self.run(m.group()), text)
        words = joined.split()
        restored = [self.word(w) for w in words]
        return joined if restored == words else " ".join(restored)

    def run(self, run: str) -> str:
        """A run of single letters: split at wide gaps, then each part decoded."""
        if not any(map(str.isalnum, run)):
            return run
        parts = re.split(r"[ ]{2,}", run)
        return " ".join(decode(self.model, p) if len(p) > 1 else p for p in parts)

    def runs(self, run: str) -> str:
        """All readings of a run of single letters, as words one after the other."""
        if not any(map(str.isalnum, run)):
            return run
        parts = re.split(r"[ ]{2,}", run)
        return " ".join(w for p in parts for w in (readings(self.model, p) or [p] if len(p) > 1 else [p]))
