"""Toxicity scores of texts in disguise, by a noisy channel.

Words written in leetspeak, letter by letter or stretched are restored: a Viterbi decoder finds
the likeliest letters under a character model of the whole corpus. Restored text is scored by
terms (words and beginnings of words) that labelled toxic documents have and clean ones lack:
each distinct word contributes the chance that its document is toxic, and the chances combine as
independent causes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm.charlm import NEAR, SPACED, CharModel, Restorer, Skeletons, may_differ, trigram_counts
from convolens.llm.common import STEP_ROWS, kept, map_batches, slices
from convolens.llm.tokens import Memo

# The fit uses this many labelled rows of each class at most; so few ids can be broadcast.
FIT_ROWS = {1: 10_000, 0: 30_000}
# A term needs this many toxic documents that are not copies of each other, or this share of them,
# and as many words that it follows: those of a shared passage always follow the same one.
SUPPORT, SUPPORT_SHARE = 4, 0.005
# Most terms looked for among clean documents, those of most toxic documents first.
TERMS = 200_000
# Terms that make toxicity likelier than this enter the score.
CHANCE = 0.5
STEMS = range(4, 8)
# Bytes of the words that a task remembers, and counts that it gathers before it sends them on.
MEMORY, GATHERED = 32 << 20, 200_000
THRESHOLD = 0.7


def core(word: str) -> str:
    """A word without case and without signs at its ends."""
    if word.isalnum():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


def terms(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends with ``*``."""
    return [word, *[word[:n] + "*" for n in STEMS if n < len(word)]]


def family(text: str, words: int = 5) -> int:
    """A hash that near copies mostly share: the least of the hashes of all word shingles."""
    tokens = text.lower().split()
    shingles = (" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)))
    return min(xxhash.xxh64_intdigest(s) for s in shingles) >> 1


class Reader:
    """What ``wanted`` finds for the distinct words of a text; it is given the cores of all readings of a word.

    A word counts as it stands and as the decoder reads it, alike in learning and in scoring. Where
    ``wanted`` looks for known terms only, give them: a word or run whose skeleton rules all of them
    out has no reading that could be one, so it is not decoded.
    """

    def __init__(self, model: CharModel, wanted, known=None):
        self.restorer, self.wanted = Restorer(model), wanted
        self.words = Memo(self._word, MEMORY)
        self.skeletons = None if known is None else Skeletons(known)

    def _word(self, word: str):
        # Most words have one reading; that is cheaper to see than a skeleton.
        if not may_differ(word) or (self.skeletons and not self.skeletons.word(word)):
            one = core(word.lower())
            return self.wanted([one] if one else [])
        cores = dict.fromkeys(core(w) for reading in self.restorer.all(word) for w in reading.split() or [""])
        return self.wanted([c for c in cores if c])

    def _run(self, run: str) -> str:
        if self.skeletons and not self.skeletons.run(run):
            return " "
        return f" {self.restorer.runs(run)} "

    def split(self, text: str) -> list[str]:
        """Words of the text, letter-by-letter writing restored."""
        return (SPACED.sub(lambda m: self._run(m.group()), text) if NEAR.search(text) else text).split()

    def read(self, text: str) -> set:
        return set(map(self.words.__getitem__, self.split(text))) - {None}


@dataclass
class ToxicityModel:
    grams: dict[int, int]
    chances: dict[str, float]
    base: float

    def reader(self) -> Reader:
        # All terms of a word begin as it does; most words begin like no known term.
        n = min(STEMS)
        heads = {t[:n] for t in self.chances}

        def wanted(words: list[str]):
            if not any(w[:n] in heads for w in words):
                return None
            found = [(self.chances[t], w) for w in words for t in terms(w) if t in self.chances]
            return max(found)[::-1] if found else None

        return Reader(CharModel(self.grams), wanted, self.chances)

    def score(self, reader: Reader, text: str | None) -> float:
        clean = 1 - self.base
        for _, chance in sorted(reader.read(text or "")):
            clean *= 1 - chance
        return 1 - clean


def _counts(docs: DataFrame, model: CharModel, allowed: frozenset) -> DataFrame:
    """``(term, n)``: documents with each of the allowed terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lambda ws: tuple({t for w in ws for t in terms(w)} & allowed) or None, allowed)
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update({t for found in reader.read(text or "") for t in found})
                if len(total) > GATHERED:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    parts = docs.select("text").mapInArrow(run, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def _support(docs: DataFrame, model: CharModel) -> DataFrame:
    """``(term, n)``: the lesser of the documents with each term and the words it follows."""

    def rows(total: Counter) -> pa.RecordBatch:
        names, after = zip(*total) if total else ((), ())
        kinds = [pa.array(names, pa.string()), pa.array(after, pa.int64()), pa.array(list(total.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(kinds, ["term", "after", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, lambda ws: tuple({t for w in ws for t in terms(w)}) or None)
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                words = reader.split(text or "")
                pairs = set()
                for before, word in zip(["", *words], words):
                    if found := reader.words[word]:
                        after = zlib.crc32(core(before).encode(errors="replace"))
                        pairs.update((t, after) for t in found)
                total.update(pairs)
                total.update({(t, -1) for t, _ in pairs})  # -1 counts documents
                if len(total) > GATHERED:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    parts = docs.select("text").mapInArrow(run, "term string, after long, n long")
    summed = parts.groupBy("term", "after").agg(F.sum("n").alias("n"))
    n_docs = F.max(F.when(F.col("after") == -1, F.col("n")))
    n_after = F.count(F.when(F.col("after") >= 0, 1))
    return summed.groupBy("term").agg(F.least(n_docs, n_after).alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    kinds = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(kinds, ["term", "n"])


def sample(labels: DataFrame, rows: dict[int, int] = FIT_ROWS) -> DataFrame:
    """``(doc_id, toxic)``: at most ``rows`` documents of each class, chosen by a hash of the id.

    Null labels are ignored, a document labelled twice is toxic if one label says so.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = dict(map(tuple, known.groupBy("toxic").count().collect()))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    chosen = None
    for toxic, most in rows.items():
        # A little less than the bound is drawn, so that the limit never decides.
        share = min(1.0, 0.97 * most / n) if (n := sizes.get(toxic, 0)) > most else 1.0
        mine = known.where((F.col("toxic") == toxic) & (part < int(share * (1 << 30)))).limit(most)
        chosen = mine if chosen is None else chosen.unionByName(mine)
    return chosen


def fit(
    docs: DataFrame,
    labels: DataFrame,
    corpus: DataFrame | None = None,
    support: int = SUPPORT,
    most_terms: int = TERMS,
    chance: float = CHANCE,
    rows: dict[int, int] = FIT_ROWS,
) -> ToxicityModel:
    """Learn from ``docs`` (``doc_id``, ``text``) that have a 0/1 ``toxic`` in ``labels``.

    The labelled rows are a sample of at most ``rows`` of each class; the character model is
    counted over every text of ``corpus`` (by default ``docs``). Toxic copies of one text count
    once, so that a large family does not make its words suspicious. The share of toxic documents
    is that of all labels. Without toxic or without clean rows the model has no terms.
    """
    everything = docs if corpus is None else corpus
    grams = dict(map(tuple, trigram_counts(everything).collect()))  # at most 60 ** 3 rows
    model = CharModel(grams)
    few = F.broadcast(sample(labels, rows))  # bounded by ``rows``
    marked = kept(docs.select("doc_id", "text").join(few, "doc_id"), "labelled")
    toxic, clean = marked.where("toxic = 1"), marked.where("toxic = 0")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        families = [family(t or "") for t in batch.column("text").to_pylist()]
        return batch.append_column("family", pa.array(families, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = kept(map_batches(toxic.select("doc_id", "text"), step, f"doc_id {kind}, text string, family long"), "families")
    firsts = named.groupBy("family").agg(F.min("doc_id").alias("doc_id"))
    distinct = named.join(firsts, ["family", "doc_id"], "left_semi")
    n_toxic, n_clean = toxic.count(), clean.count()
    n_distinct = max(1, firsts.count())
    least = max(support, SUPPORT_SHARE * n_distinct)
    found = _support(distinct, model).where(F.col("n") >= least)
    often = {r["term"]: r["n"] for r in found.orderBy(F.desc("n"), "term").limit(most_terms).collect()}
    if not often or not n_clean:
        return ToxicityModel(grams, {}, 0.5 if not n_clean else 0.0)
    rare = dict(map(tuple, _counts(clean, model, frozenset(often)).collect()))
    share = labels.where("toxic IN (0, 1)").agg(F.avg("toxic")).first()[0]
    chances = {}
    for term, n in often.items():
        # Few documents prove little: the rate is taken some standard errors below what was seen.
        toxic_rate = share * min(1.0, max(0.0, n - 1.5 * n**0.5) / n_distinct)
        clean_rate = (1 - share) * (rare.get(term, 0) + 0.5) / n_clean
        if (p := toxic_rate / (toxic_rate + clean_rate)) >= chance:
            chances[term] = p
    return ToxicityModel(grams, _without_echoes(chances, often), share / 10)


def _without_echoes(chances: dict[str, float], often: dict[str, int]) -> dict[str, float]:
    """Leave out stems that owe at least half of their documents to a longer, surer stem."""
    surer = set()
    for term, p in chances.items():
        if term.endswith("*") and len(term) > STEMS[0] + 1:
            shorter = term[:-2] + "*"
            if chances.get(shorter, 1.0) < p - 0.01 and often[term] >= often[shorter] / 2:
                surer.add(shorter)
    return {t: p for t, p in chances.items() if t not in surer}


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, drop_text: bool = False) -> DataFrame:
    """Add ``score`` (0..1) and ``predicted`` (1 from ``threshold`` on) to documents with ``text``.

    Only the text decides. Null and empty texts get the base score. Columns of those names are
    replaced, every row gives a row; ``drop_text`` leaves the text out.
    """
    plain = docs.drop("score", "predicted")
    scored = plain.withColumn("score", score_column(plain.sparkSession, model, F.col("text")))
    kept_columns = [c for c in plain.columns if not (drop_text and c == "text")]
    return scored.select(*kept_columns, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score of a text column. Only texts go to the Python workers, and only scores come back."""
    shared = spark.sparkContext.broadcast(model)  # terms and trigrams, both bounded

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = shared.value.reader()
        for batch in batches:
            texts = (t for i in range(0, len(batch), STEP_ROWS) for t in batch.slice(i, STEP_ROWS).to_pylist())
            yield pa.array([shared.value.score(reader, t) for t in texts], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # A filter on the score must not work it out a second time.
    return F.arrow_udf(run, "double").asNondeterministic()(text)


def restore(docs: DataFrame, grams: dict[int, int]) -> DataFrame:
    """Add ``restored``, the text as it was meant, to documents with a ``text`` column; null stays."""
    plain = docs.drop("restored")
    model = CharModel(grams)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches):
            texts = [None if t is None else restorer.restore(t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("restored", pa.array(texts, pa.string()))

    return plain.mapInArrow(run, f"{fields}, restored string")
