"""Message sentiment from a caller's lexicon, worked out inside the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.runtime import fits, join_small

# --- fixed values (Hutto and Gilbert 2014) --------------------------------------------------------
# Valence sum -> score: s / sqrt(s^2 + 15).
ALPHA = 15.0
# Share of a booster's weight at a distance of one, two and three words.
DAMPING = (1.0, 0.95, 0.9)
# Factor a negation within the three preceding words applies.
NEGATION = -0.74
NEGATIONS = (
    "aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt "
    "neither never none nope nor not nothing nowhere rarely seldom shouldnt wasnt werent without "
    "wont wouldnt"
).split()
BOOST = 0.293
BOOSTERS = "absolutely completely extremely highly really so totally very".split()
DAMPENERS = "almost barely hardly kinda marginally partly slightly somewhat".split()
# A word in capitals among others that are not.
CAPITALS = 0.733
# Valences before and after the word that turns a message around.
TURN, BEFORE_TURN, AFTER_TURN = "but", 0.5, 1.5
# Each of the first four exclamation marks; two or three question marks each, and more of them.
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS, MORE_QUESTIONS = 0.18, 3, 0.96
# -------------------------------------------------------------------------------------------------


def message_sentiment(
    messages: DataFrame, lexicon: DataFrame, by: Sequence[str] = (), rules: bool = False, emphasis: bool = False
) -> DataFrame:
    """``(chat_id, seq, user, sentiment)`` from a ``(token, valence)`` lexicon; blank messages are left out.

    The valences of a message's tokens are summed and squashed into -1..1. ``rules`` also turns
    valences after a negation and scales them after boosters, looking at the three tokens before.
    ``emphasis`` strengthens words in capitals (where not all are), weighs what stands before and
    after the first "but", and adds exclamation and question marks to the sum.

    The tokens of a message stay in its row: the lexicon goes to the tasks, which look up the tokens
    of a whole batch and shift them against each other for the rules. A lexicon that a count does
    not prove small is joined, token by token, before that.
    """
    key = list(dict.fromkeys([*by, "chat_id", "seq", "user"]))
    kept = messages.where(F.col("message").isNotNull() & ~text.is_blank(F.col("message")))
    rows = kept.select(*key, *_parts(emphasis))
    words = lexicon.where("token IS NOT NULL").groupBy("token").agg(F.max("valence").cast("double").alias("valence"))
    if fits(words):
        table = words.toArrow()
        known = (table.column("token").combine_chunks(), pc.fill_null(table.column("valence"), 0.0).to_numpy())
    else:
        known, rows = None, _with_valences(rows, words, key)
    shared = messages.sparkSession.sparkContext.broadcast(known)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = _sums(batch, shared.value, rules, emphasis)
            yield batch.select(key).append_column("s", pa.array(total, pa.float64()))

    s = F.col("s")
    return rows.mapInArrow(run, f"{kinds}, s double").select(*key, (s / F.sqrt(s * s + ALPHA)).alias("sentiment"))


def _parts(emphasis: bool) -> list[Column]:
    """The tokens of a message, and with ``emphasis`` which are capitals and what the marks add."""
    body = F.col("message") if emphasis else F.lower("message")
    found = F.transform(
        F.regexp_extract_all(body, F.lit(f"[{text.WORD}']+"), 0), lambda t: F.replace(t, F.lit("'"), F.lit(""))
    )
    if not emphasis:
        return [found.alias("toks")]
    loud = F.least(F.regexp_count("message", F.lit("!")), F.lit(EXCLAMATIONS)) * EXCLAMATION
    asked = F.regexp_count("message", F.lit(r"\?"))
    doubt = F.when(asked > QUESTIONS, MORE_QUESTIONS).when(asked > 1, asked * QUESTION).otherwise(0.0)
    return [
        F.transform(found, lambda t: F.lower(t)).alias("toks"),
        F.transform(found, lambda t: (F.upper(t) == t) & (F.lower(t) != t)).alias("upper"),
        (loud + doubt).alias("marks"),
    ]


def _with_valences(rows: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """Add ``valences``, aligned with the tokens, from a lexicon of any size."""
    each = rows.select("chat_id", "seq", F.posexplode("toks").alias("pos", "token"))
    met = join_small(each, words, ["token"], spread_by=["chat_id", "seq"], max_rows=0)
    cells = F.map_from_entries(F.collect_list(F.struct("pos", "valence")))
    found = met.groupBy("chat_id", "seq").agg(cells.alias("_found"))
    at = lambda t, i: F.coalesce(F.try_element_at("_found", i), F.lit(0.0))
    return rows.join(found, ["chat_id", "seq"], "left").withColumn("valences", F.transform("toks", at)).drop("_found")


def _sums(batch: pa.RecordBatch, known: tuple | None, rules: bool, emphasis: bool) -> np.ndarray:
    """The valence sum of every message of a batch."""
    lists = batch.column("toks")
    tokens = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    if known is None:
        valence = batch.column("valences").flatten().to_numpy(zero_copy_only=False).copy()
    else:
        code = pc.fill_null(pc.index_in(tokens, value_set=known[0]), len(known[1])).to_numpy()
        valence = np.r_[known[1], 0.0][code]
    sign, loud = np.sign(valence), np.zeros(len(tokens), dtype=bool)
    if emphasis:
        upper = batch.column("upper").flatten().to_numpy(zero_copy_only=False).astype(bool)
        n_upper = np.bincount(row, upper, minlength=len(lists))
        loud = upper & ((n_upper > 0) & (n_upper < sizes))[row]
        valence = valence + sign * CAPITALS * loud
    if rules:
        valence = _in_context(tokens, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], valence, sign, loud)
    if emphasis:
        turn = np.flatnonzero(_among(tokens, [TURN]))[::-1]
        first = np.full(len(lists), len(tokens))
        first[row[turn]] = turn  # the first one is written last
        place = np.arange(len(tokens))
        turned = first[row] < len(tokens)
        valence = valence * np.where(turned & (place < first[row]), BEFORE_TURN, np.where(turned & (place > first[row]), AFTER_TURN, 1.0))
    total = np.bincount(row, valence, minlength=len(lists)).astype(np.float64)
    if emphasis:
        total = total + np.sign(total) * batch.column("marks").to_numpy(zero_copy_only=False)
    return total


def _among(tokens: pa.Array, words: list[str]) -> np.ndarray:
    return pc.is_in(tokens, value_set=pa.array(words)).to_numpy(zero_copy_only=False)


def _in_context(tokens: pa.Array, place: np.ndarray, valence: np.ndarray, sign: np.ndarray, loud: np.ndarray) -> np.ndarray:
    """Valences after the booster and negation words among the three tokens before each."""
    up, down = _among(tokens, BOOSTERS), _among(tokens, DAMPENERS)
    step = BOOST * up - BOOST * down + CAPITALS * (loud & (up | down))
    negation = _among(tokens, NEGATIONS)
    negated = np.zeros(len(tokens), dtype=bool)
    for back, weight in enumerate(DAMPING, 1):
        own = np.flatnonzero(place >= back)
        valence[own] += sign[own] * step[own - back] * weight
        negated[own] |= negation[own - back]
    return np.where(negated, valence * NEGATION, valence)
