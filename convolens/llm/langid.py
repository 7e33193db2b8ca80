"""Language identification with a string kernel.

Two texts are compared by the n-grams (1 to ``N`` characters) that both contain: the blended
spectrum kernel on presence, divided by the sizes of the two sets. A sample of training texts
gives landmarks; the kernel against them, whitened by the landmarks' own kernel matrix, is the
Nystroem approximation of the kernel's feature space. There a ridge regression per language
against the rest is solved in closed form. Texts and landmarks meet in every n-gram of code points that a
landmark holds, looked up by its exact code; n-grams that no landmark holds only count in the size
of a text. Landmarks' n-grams times regression weights are one table of n-grams by languages, so
scoring a batch is the product of its sparse matrix of texts by n-grams with that table.

The fit uses a sample of labelled rows of bounded size (``per_language`` rows of each language), of
which only the sets of n-grams leave the tasks, so texts of any length teach; scoring covers the whole
of every text. Landmarks grow with the number of languages.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import kept, map_batches
from convolens.llm.vectors import matrix
from convolens.runtime import join_small

N = 3
LANDMARKS = 256
PER_LANGUAGE = 500
# Characters whose n-grams are gathered at once, and entries of a batch's sparse matrix multiplied at once.
STRETCH = 1 << 20
ENTRIES = 1 << 20
# Landmarks of each language at least.
EACH = 4
# Bits of a code point, so that three of them are one integer; and of the table that n-grams are looked up in.
POINT, SLOTS = 21, 20
RIDGE = 1e-3
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def held_out(ids: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of an id as text falls into ``fold``; false for a null id."""
    return F.coalesce((F.crc32(ids.cast("string")) % folds) == fold, F.lit(False))


def all_grams(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of a text, ascending; what is no letter is a gap, gaps in a row are one.

    Long texts are taken in stretches, so memory holds one stretch and the distinct n-grams.
    """
    found, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, max(1, len(text)), STRETCH):
        part = text[start : start + STRETCH].lower()
        part = (" " if not start else "") + part + (" " if start + STRETCH >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.concatenate([last, _letters(points)])  # goes on where the stretch before ended
        gap = code == GAP
        code = code[~(gap & np.r_[False, gap[:-1]])]
        grams, run = [found, code], code
        for n in range(1, N):
            run = run[:-1] << POINT | code[n:]  # code points are above 0, so lengths do not mix
            grams.append(run)
        found, last = np.unique(np.concatenate(grams)), code[1 - N :]
    return found


GAP = ord(" ")
# Code points to themselves if they are letters or marks of letters, to the gap otherwise.
_KEPT = np.zeros(0x110000, dtype=bool)
_SEEN = np.zeros(0x110000, dtype=bool)


def _letters(points: np.ndarray) -> np.ndarray:
    new = points[~_SEEN[points]]
    for point in np.unique(new):
        _KEPT[point] = chr(point).isalpha() or unicodedata.category(chr(point))[0] == "M"
    _SEEN[new] = True
    return np.where(_KEPT[points], points, GAP).astype(np.int64)


class Grams:
    """The n-grams that landmarks contain, as features in ascending order of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        # The feature of a slot, -1 for none, -2 for several: those are searched for in the codes.
        self.slots = np.full(1 << SLOTS, -1, dtype=np.int32)
        slot = self.slot(codes)
        self.slots[slot] = np.arange(len(codes))
        taken, n = np.unique(slot, return_counts=True)
        self.slots[taken[n > 1]] = -2

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - SLOTS)).astype(np.int64)

    def features(self, grams: np.ndarray) -> np.ndarray:
        """Features of the n-grams among ``grams`` that landmarks contain."""
        at = self.slots[self.slot(grams)]
        grams, at = grams[at != -1], at[at != -1]
        crowded = at == -2
        at[crowded] = np.minimum(np.searchsorted(self.codes, grams[crowded]), len(self.codes) - 1)
        return at[self.codes[at] == grams]


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    held: list[np.ndarray]  # features of each landmark
    weights: np.ndarray  # landmarks x languages
    table: np.ndarray | None = None  # features x languages, and a last row of zeros

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts and landmarks: shared n-grams by the roots of the sizes of both sets."""
        return self.kernel_of([all_grams(t) for t in texts])

    def kernel_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of landmarks and sets of n-grams."""
        out = np.zeros((len(sets), len(self.held)))
        marks = np.repeat(np.arange(len(self.held)), [len(h) for h in self.held])
        flat = np.concatenate(self.held)
        order = np.argsort(flat, kind="stable")
        marks, bounds = marks[order], np.searchsorted(flat[order], np.arange(len(self.grams.codes) + 1))
        for row, grams in enumerate(sets):
            at = self.grams.features(grams)
            size = bounds[at + 1] - bounds[at]
            # Places of all landmarks of all features of the text, one range after the other.
            places = np.arange(size.sum()) + np.repeat(bounds[at] - np.cumsum(size) + size, size)
            out[row] = np.bincount(marks[places], minlength=len(self.held)) / np.sqrt(len(grams))
        return out / np.sqrt([max(1, len(h)) for h in self.held])

    def close(self) -> Model:
        """Bring landmarks and weights into one table, all that scoring needs."""
        self.table = np.zeros((len(self.grams.codes) + 1, len(self.languages)), dtype=np.float32)
        for held, weight in zip(self.held, self.weights):
            self.table[held] += (weight / np.sqrt(max(1, len(held)))).astype(np.float32)
        return self

    def values(self, texts: list[str]) -> np.ndarray:
        """Regression values of texts and languages: the kernel times the weights."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        first = size = 0
        for row, text in enumerate(texts):
            grams = all_grams(text)
            held.append(self.grams.features(grams))
            size += len(held[-1])
            out[row] = 1 / np.sqrt(len(grams))
            if size * len(self.languages) > ENTRIES or row == len(texts) - 1:
                out[first : row + 1] *= self._product(held)
                held, first, size = [], row + 1, 0
        return out

    def _product(self, held: list[np.ndarray]) -> np.ndarray:
        """The sparse matrix with ones at the features ``held`` of each row, times the table."""
        # An empty row takes a row of zeros, as a sum over nothing is none of ``reduceat``'s.
        ends = np.cumsum([len(h) + 1 for h in held])
        rows = np.concatenate([np.append(h, len(self.table) - 1) for h in held])
        return np.add.reduceat(self.table[rows], np.r_[0, ends[:-1]], axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t if t and LETTER.search(t) else "" for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        value = self.values(known)
        best = value.argmax(axis=1)
        # Targets are 1 and 0, so the winning value is a score once it is brought into 0..1.
        score = np.clip(value[np.arange(len(best)), best], 0, 1)
        lang = [self.languages[b] if t else UNKNOWN for b, t in zip(best, known)]
        return lang, np.where([bool(t) for t in known], score, 0.0)


def fit_texts(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on texts in a fixed order; see ``fit_sets``."""
    return fit_sets([all_grams(t) for t in texts], labels, landmarks, ridge)


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on sets of n-grams in a fixed order; see ``marked`` for the landmarks."""
    marks = marked(labels, landmarks)
    model = _of_landmarks(sorted(set(labels)), [sets[i] for i in marks])
    return _regressed(model, model.kernel_of(sets), marks, labels, ridge) if marks else model


def marked(labels: list[str], landmarks: int) -> list[int]:
    """Places of the landmarks: the first row of each language, then the second, and so on."""
    seen: dict[str, int] = {}
    turn = []
    for i, lang in enumerate(labels):
        seen[lang] = seen.get(lang, 0) + 1
        turn.append((seen[lang], lang, i))
    return [i for _, _, i in sorted(turn)[:landmarks]]


def _of_landmarks(languages: list[str], codes: list[np.ndarray]) -> Model:
    grams = Grams(np.unique(np.concatenate([np.zeros(0, np.int64), *codes])))
    return Model(languages, grams, [grams.features(c) for c in codes], np.zeros((len(codes), len(languages))))


def _regressed(model: Model, kernel: np.ndarray, marks: list[int], labels: list[str], ridge: float) -> Model:
    # Nystroem features: kernel values times the inverse root of the landmarks' own matrix.
    own, vectors = np.linalg.eigh(kernel[marks])
    use = own > 1e-6 * own.max()
    root = vectors[:, use] / np.sqrt(own[use])
    z = kernel @ root
    target = np.array([[x == lang for lang in model.languages] for x in labels], dtype=np.float64)
    share = target.mean(axis=0)
    weigh = (target / np.maximum(share, 1e-9)).sum(axis=1, keepdims=True)  # languages weigh alike
    gram = z.T @ (z * weigh) + ridge * len(labels) * np.eye(z.shape[1])
    model.weights = root @ np.linalg.solve(gram, z.T @ (target * weigh))
    return model.close()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most ``per_language`` rows ``(doc_id, text, lang)`` of each language.

    The sample is drawn by a hash of id and text, so it does not depend on the order of rows; rows
    that repeat both are drawn alike. Rows with null language or without a letter are not drawn. There
    are ``EACH`` landmarks of each language where that is more than ``landmarks``.
    """
    fits = F.col("lang").isNotNull()
    drawn = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11))
    part = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    counts = docs.where(fits).groupBy("lang").agg(F.count(F.lit(1)).alias("_all"))
    # A little over the wanted share is drawn, and the surplus dropped here, lowest hashes first.
    share = F.least(F.lit(1.0), F.lit((per_language + 100) * 1.1) / F.col("_all"))
    shares = counts.select("lang", share.alias("_share"))
    rows = docs.where(fits & F.col("text").rlike(r"\p{L}")).select("lang", drawn.alias("at"), part.alias("part"), "text")
    rows = join_small(rows, shares, ["lang"], ["at"]).where("part < _share")

    def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([all_grams(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        return batch.drop_columns(["text"]).append_column("grams", sets)

    drawn_rows = rows.select("lang", "at", "text")
    sets = kept(map_batches(drawn_rows, gathered, "lang string, at long, grams array<long>", rows=64), "sample")
    keys: list[tuple[str, int]] = []
    taken: dict[str, int] = {}
    for lang, at in sorted(map(tuple, sets.select("lang", "at").collect())):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_language:
            keys.append((lang, at))
    labels = [lang for lang, _ in keys]
    marks = marked(labels, max(landmarks, EACH * len(taken)))
    if not marks:
        return _of_landmarks([], [])
    # Only landmarks' n-grams and a kernel row of each other row come to the driver.
    wanted = sets.where(F.col("at").isin([keys[i][1] for i in marks])).toArrow()
    found = zip(wanted.column("lang").to_pylist(), wanted.column("at").to_pylist(), wanted.column("grams"))
    codes = {(lang, at): grams.values.to_numpy() for lang, at, grams in found}
    model = _of_landmarks(sorted(taken), [codes[keys[i]] for i in marks])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by n-grams of landmarks

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        kernel = shared.value.kernel_of([g.values.to_numpy() for g in batch.column("grams")])
        return batch.drop_columns(["grams"]).append_column("kernel", pa.array(list(kernel), pa.list_(pa.float64())))

    got = map_batches(sets, compared, "lang string, at long, kernel array<double>").toArrow()
    by_key = dict(zip(zip(got.column("lang").to_pylist(), got.column("at").to_pylist()), matrix(got.column("kernel"))))
    return _regressed(model, np.stack([by_key[k] for k in keys]), marks, labels, RIDGE)


def identify(docs: DataFrame, model: Model, drop_text: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents with a ``text`` column, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if the
    model knows no language. Columns of those names are replaced; ``drop_text`` leaves the text out.
    """
    plain = docs.drop("lang_pred", "score")
    shared = plain.sparkSession.sparkContext.broadcast(model)  # bounded by n-grams of landmarks x languages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if not (drop_text and f.name == "text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(batch.column("text").to_pylist())
        rest = batch.drop_columns(["text"]) if drop_text else batch
        rest = rest.append_column("lang_pred", pa.array(lang, pa.string()))
        return rest.append_column("score", pa.array(score, pa.float64()))

    return map_batches(plain, step, f"{fields}, lang_pred string, score double", rows=256)
