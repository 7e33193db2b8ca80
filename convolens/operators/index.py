"""Index tables: inverted word index, TF-IDF vocabulary and weights, user profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.functions.arrays import let, run_lengths
from convolens.operators.grams import Grams, Known, order_of, split, steps, tallied
from convolens.operators.ranking import top_k
from convolens.runtime import BROADCAST_ROWS, fits, join_small, stored

# --- fixed values -------------------------------------------------------------------------------
MAX_FEATURES = 10_000
MIN_DF = 2
MAX_DF = 0.9
NGRAMS = (1, 3)
MIN_WORD_LENGTH = 3
PROFILE_WORDS = 10
# Bytes of text per partition in which terms are counted.
COUNT_BYTES = 32 << 20
# -------------------------------------------------------------------------------------------------


def indexable(messages: DataFrame, keep_marks: bool = False) -> DataFrame:
    """Messages with a body (an empty one counts), plus ``clean_text``."""
    kept = messages.where(F.col("message").isNotNull())
    return kept.withColumn("clean_text", text.clean_text(F.col("message"), keep_marks))


def word_postings(messages: DataFrame) -> DataFrame:
    """``(word, chat_id, seq)`` for the distinct longer words of each clean text; no shuffle."""
    return postings_of(indexable(messages))


def postings_of(texts: DataFrame) -> DataFrame:
    """``word_postings`` of texts that are clean already."""
    return postings_in(word_lists(texts))


def word_lists(texts: DataFrame) -> DataFrame:
    """``(chat_id, seq, keys)``: the postings of clean texts with a row per message."""
    words = F.array_distinct(F.split(F.col("clean_text"), " "))
    return texts.select("chat_id", "seq", F.filter(words, lambda w: F.length(w) >= MIN_WORD_LENGTH).alias("keys"))


def postings_in(lists: DataFrame) -> DataFrame:
    # A plain explode would add a filter on the list, for which the list is worked out once more.
    return lists.select(F.explode_outer("keys").alias("word"), "chat_id", "seq").where("word IS NOT NULL")


def rows_by_key(lists: DataFrame, **named: str) -> DataFrame:
    """``(key, chat_id, seq, ...)``: a row per message and key, by key within each step of a task.

    ``named`` says which list gives which column, the keys first. Nothing is shuffled or sorted as a
    whole: pages of a file written so have narrow ranges of keys, which is what a search for few needs.
    """
    (key, keys), *others = named.items()
    kind = lambda c: lists.schema[c].dataType.elementType.simpleString()
    schema = ", ".join([f"{key} string, chat_id string, seq long", *(f"{n} {kind(c)}" for n, c in others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, keys, pc.list_value_length):
            cells = batch.column(keys)
            coded, row = cells.flatten().dictionary_encode(), pc.list_parent_indices(cells).to_numpy()
            names = pc.sort_indices(coded.dictionary)
            place = np.argsort(names.to_numpy())[coded.indices.to_numpy()]
            order = order_of(place)
            ids = [batch.column(c).take(pa.array(row[order])) for c in ("chat_id", "seq")]
            rest = [batch.column(c).flatten().take(pa.array(order)) for _, c in others]
            columns = [coded.dictionary.take(coded.indices.take(pa.array(order))), *ids, *rest]
            yield pa.RecordBatch.from_arrays(columns, [key, "chat_id", "seq", *(n for n, _ in others)])

    return lists.select("chat_id", "seq", *named.values()).mapInArrow(run, schema)


def word_freq(postings: DataFrame) -> DataFrame:
    """``(word, df)``: number of messages with the word."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def term_counts(messages: DataFrame, ngram_range: tuple[int, int] = NGRAMS) -> DataFrame:
    """``(chat_id, seq, term, tf)``, counted inside each row, so without a shuffle."""
    return counts_of(indexable(messages), ngram_range)


def counts_of(texts: DataFrame, ngram_range: tuple[int, int] = NGRAMS) -> DataFrame:
    """``term_counts`` of texts that are clean already."""
    return counts_in(count_lists(texts, ngram_range))


def count_lists(texts: DataFrame, ngram_range: tuple[int, int] = NGRAMS) -> DataFrame:
    """``(chat_id, seq, counts)``: the term counts of clean texts with a row per message; null for none."""
    grams = text.ngrams(text.tokens(F.col("clean_text")), *ngram_range)
    return texts.select("chat_id", "seq", run_lengths(grams).alias("counts"))


def counts_in(lists: DataFrame) -> DataFrame:
    # A plain inline would add a filter on the list, for which the list is worked out once more.
    each = lists.select("chat_id", "seq", F.inline_outer("counts")).where("value IS NOT NULL")
    return each.select("chat_id", "seq", F.col("value").alias("term"), F.col("n").cast("long").alias("tf"))


def tfidf_vocabulary(
    messages: DataFrame,
    ngram_range: tuple[int, int] = NGRAMS,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``(term, df, total, idf)`` of the kept terms; ``idf = ln((1 + n) / (1 + df)) + 1``.

    Terms are counted length by length, and only those that can still be kept (``candidate_sums``).
    """
    tokens = stored(token_lists(indexable(messages)))
    return vocabulary_of(tokens, tokens.count(), ngram_range, min_df, max_df, max_features)


def token_lists(texts: DataFrame) -> DataFrame:
    """``(chat_id, seq, tokens)`` of clean texts: a text that has the tokens between ASCII signs.

    A clean text is one already, but for the combining marks it may keep. ``text.tokens`` and
    ``grams.split`` read the tokens from it; as a list of strings they would cost several times more.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), f"[^{text.WORD}]+", " ")
    cut = let(F.col("clean_text"), lambda c: F.when(c.rlike(r"\p{M}"), plain(c)).otherwise(c))
    return texts.select("chat_id", "seq", cut.alias("tokens"))


def vocabulary_of(
    tokens: DataFrame,
    n: int,
    ngram_range: tuple[int, int] = NGRAMS,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``tfidf_vocabulary`` from the token lists of ``n`` messages; they are read once per length."""
    sums = candidate_sums(tokens, n, ngram_range, min_df, max_df, max_features)
    return vocabulary_in(sums, n, min_df, max_df, max_features)


def candidate_sums(
    tokens: DataFrame, n: int, ngram_range: tuple[int, int], min_df: int, max_df: float, max_features: int | None
) -> DataFrame:
    """``term_sums`` of all terms that ``vocabulary_in`` can keep, and of some others.

    A term occurs at most as often as each part of it, and in at most as many messages. So a term is
    counted only if the two terms one word shorter in it are in ``min_df`` messages and as frequent
    as the last of the ``max_features`` best of the terms known so far: no other can be kept. Where
    so many terms pass that they do not fit a broadcast, all terms are counted as strings.
    """
    low, high = ngram_range
    size = tokens.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    parts = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-size // COUNT_BYTES))
    ones = stored(_word_sums(tokens, parts))
    found, known, grams = ([ones] if low == 1 else []), ones, None
    for length in range(2, high + 1):
        least = 1
        if max_features is not None and found:
            so_far = vocabulary_in(reduce(DataFrame.unionByName, found), n, min_df, max_df, max_features)
            count, rarest = so_far.agg(F.count(F.lit(1)), F.min("total")).first()
            least = rarest if count == max_features > 0 else 1
        known = known.where((F.col("df") >= min_df) & (F.col("total") >= least))
        if not fits(known):
            every = tokens.select("chat_id", "seq", run_lengths(text.ngrams(text.tokens(F.col("tokens")), low, high)).alias("counts"))
            return term_sums(counts_in(every))
        if grams is None:
            grams = Grams(known.select("term").sort("term").toArrow().column("term").combine_chunks())
        else:
            grams = Grams(grams.words, [*grams.levels, np.sort(known.select("number").toArrow().column("number").to_numpy())])
        known = stored(_gram_sums(tokens, grams, length, parts))
        if length >= low:
            found.append(_named(known.where((F.col("df") >= min_df) & (F.col("total") >= least)), grams, length))
    return reduce(DataFrame.unionByName, found)


def _word_sums(tokens: DataFrame, parts: int) -> DataFrame:
    """``term_sums`` of single tokens, combined in the tasks step by step before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tokens"):
            flat, row = split(batch.column("tokens"))
            coded = flat.dictionary_encode()
            code, df, total = tallied(row, coded.indices.to_numpy())
            cells = [coded.dictionary.take(pa.array(code)), pa.array(df, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, ["term", "df", "total"])

    return _added(tokens.select("tokens").mapInArrow(run, "term string, df long, total long"), "term", parts)


def _added(sums: DataFrame, key: str, parts: int) -> DataFrame:
    """Sums per key, in a number of partitions that goes with the input.

    The steps have combined what they can; combined once more before the shuffle, mostly single rows
    would fill a task's memory.
    """
    return sums.repartition(parts, key).groupBy(key).agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _gram_sums(tokens: DataFrame, grams: Grams, length: int, parts: int) -> DataFrame:
    """``(number, df, total)`` of n-grams whose parts are known."""
    shared = tokens.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tokens"):
            flat, row = split(batch.column("tokens"))
            number = shared.value.numbers(flat, row, length)
            cells = [pa.array(c, pa.int64()) for c in tallied(row, number)]
            yield pa.RecordBatch.from_arrays(cells, ["number", "df", "total"])

    return _added(tokens.select("tokens").mapInArrow(run, "number long, df long, total long"), "number", parts)


def _named(sums: DataFrame, grams: Grams, length: int) -> DataFrame:
    shared = sums.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = shared.value.named(length, batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([names, *batch.columns[1:]], ["term", "df", "total"])

    return sums.select("number", "df", "total").mapInArrow(run, "term string, df long, total long")


def term_sums(counts: DataFrame) -> DataFrame:
    """``(term, df, total)``: messages with the term and its occurrences."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def vocabulary_in(
    sums: DataFrame,
    n: Column | int,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``tfidf_vocabulary`` from ``term_sums`` over ``n`` messages."""
    n = n if isinstance(n, Column) else F.lit(n)
    kept = sums.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    if max_features is not None:
        kept = top_k(kept, [F.desc("total"), F.asc("term")], max_features)
    return kept.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def tfidf_weights(
    messages: DataFrame,
    vocabulary: DataFrame,
    ngram_range: tuple[int, int] = NGRAMS,
    max_features: int | None = MAX_FEATURES,
) -> DataFrame:
    """``(term, chat_id, seq, tf, weight)`` with L2-normalised weights per message.

    ``max_features`` is the cap the vocabulary was built with. It proves the broadcast side small;
    an uncapped vocabulary is counted first.
    """
    return weight_rows(token_lists(indexable(messages)), vocabulary, ngram_range, max_features)


def own_weights(messages: DataFrame) -> DataFrame:
    """``tfidf_weights`` by the messages' own ``tfidf_vocabulary``; the texts are cleaned once."""
    tokens = stored(token_lists(indexable(messages)))
    return weight_rows(tokens, vocabulary_of(tokens, tokens.count()))


def weights_in(lists: DataFrame) -> DataFrame:
    """``tfidf_weights`` from a row per message."""
    return lists.select("chat_id", "seq", F.inline(F.arrays_zip("keys", "tfs", "weights"))).select(
        F.col("keys").alias("term"), "chat_id", "seq", F.col("tfs").alias("tf"), F.col("weights").alias("weight")
    )


LISTS = "chat_id string, seq long, keys array<string>, tfs array<long>, weights array<double>"
ROWS = "term string, chat_id string, seq long, tf long, weight double"


def weight_lists(
    tokens: DataFrame, vocabulary: DataFrame, ngram_range: tuple[int, int] = NGRAMS, max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """``(chat_id, seq, keys, tfs, weights)`` of ``token_lists``: the vocabulary's terms of a message.

    A message's terms stand in one row, so the look-up and the norm need no shuffle: the vocabulary
    goes to the tasks, which look up the terms of many messages at a time. A vocabulary that is not
    proven small by ``max_features`` or a count is joined instead, term by term.
    """
    found = _looked_up(tokens, vocabulary, ngram_range, max_features, _lists_of, LISTS)
    return _joined_lists(tokens, vocabulary, ngram_range) if found is None else found


def weight_rows(
    tokens: DataFrame, vocabulary: DataFrame, ngram_range: tuple[int, int] = NGRAMS, max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """``tfidf_weights`` of ``token_lists``, by term within each step of a task."""
    found = _looked_up(tokens, vocabulary, ngram_range, max_features, _rows_of, ROWS)
    return weights_in(_joined_lists(tokens, vocabulary, ngram_range)) if found is None else found


def _looked_up(tokens: DataFrame, vocabulary: DataFrame, ngram_range: tuple[int, int], max_features: int | None, make, schema: str):
    """What ``make`` makes of a batch and its weights; None for a vocabulary that is not proven small."""
    known = vocabulary.select("term", "idf")
    if not (max_features <= BROADCAST_ROWS if max_features is not None else fits(known)):
        return None
    table = known.toArrow()
    terms = Known(table.column("term").to_pylist(), table.column("idf").to_numpy())
    shared = tokens.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tokens"):
            yield make(batch, shared.value, *_weighted(batch, shared.value, *ngram_range))

    return tokens.select("chat_id", "seq", "tokens").mapInArrow(run, schema)


def _weighted(batch: pa.RecordBatch, known: Known, low: int, high: int) -> tuple[np.ndarray, ...]:
    """``(row, term, tf, weight)`` of a batch's terms that the vocabulary has."""
    row, term, tf = known.counted(batch.column("tokens"), low, high)
    raw = tf * known.values[term]
    norm = np.sqrt(np.bincount(row, raw * raw, minlength=batch.num_rows))
    return row, term, tf, raw / norm[row]


def _lists_of(batch: pa.RecordBatch, known: Known, row, term, tf, weight) -> pa.RecordBatch:
    """The messages that have any term."""
    size = np.bincount(row, minlength=batch.num_rows)
    some = np.flatnonzero(size)
    ends = pa.array(np.r_[0, np.cumsum(size[some])].astype(np.int32))
    ids = [batch.column(c).take(pa.array(some)) for c in ("chat_id", "seq")]
    lists = [pa.ListArray.from_arrays(ends, cell) for cell in (known.terms.take(pa.array(term)), pa.array(tf), pa.array(weight))]
    return pa.RecordBatch.from_arrays([*ids, *lists], ["chat_id", "seq", "keys", "tfs", "weights"])


def _rows_of(batch: pa.RecordBatch, known: Known, row, term, tf, weight) -> pa.RecordBatch:
    order = order_of(term)
    ids = [batch.column(c).take(pa.array(row[order])) for c in ("chat_id", "seq")]
    cells = [known.terms.take(pa.array(term[order])), *ids, pa.array(tf[order]), pa.array(weight[order])]
    return pa.RecordBatch.from_arrays(cells, ["term", "chat_id", "seq", "tf", "weight"])


def _joined_lists(tokens: DataFrame, vocabulary: DataFrame, ngram_range: tuple[int, int]) -> DataFrame:
    """``weight_lists`` with a vocabulary of any size."""
    grams = text.ngrams(text.tokens(F.col("tokens")), *ngram_range)
    lists = tokens.select("chat_id", "seq", run_lengths(grams).alias("counts"))
    hits = join_small(counts_in(lists), vocabulary.select("term", "idf"), ["term"], spread_by=["chat_id", "seq"], max_rows=0)
    raw = F.struct("term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
    gathered = hits.groupBy("chat_id", "seq").agg(F.sort_array(F.collect_list(raw)).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda s, c: s + c["w"] * c["w"])
    cells = gathered.withColumn("norm", F.sqrt(total))
    return cells.select(
        "chat_id", "seq",
        F.transform("c", lambda c: c["term"]).alias("keys"),
        F.transform("c", lambda c: c["tf"]).alias("tfs"),
        F.transform("c", lambda c: c["w"] / F.col("norm")).alias("weights"),
    )


def user_profile(
    messages: DataFrame, by: Sequence[str] = (), n_words: int = PROFILE_WORDS
) -> DataFrame:
    """Message count, mean length and most used words per user.

    The words are counted before they are gathered: a profile holds ``n_words`` structs however
    much its user wrote.
    """
    texts = indexable(messages).withColumn("chars", F.length("message"))
    return profiles_in(profile_counts(texts, by), by, n_words)


def profile_counts(texts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What profiles are made of, ``(*by, user, word, n, chars)``, from clean texts with ``chars``.

    A row per word of a user, and one with a null word that counts the messages and their length.
    Such tables of different messages add up.
    """
    words = F.filter(F.split("clean_text", " "), lambda w: w != "")
    cells = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("word"), F.col("chars").cast("long").alias("chars"))),
        F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(None).cast("long").alias("chars"))),
    )
    each = texts.where(F.col("user").isNotNull()).select(*by, "user", F.inline(cells))
    return each.groupBy(*by, "user", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def profiles_in(counts: DataFrame, by: Sequence[str] = (), n_words: int = PROFILE_WORDS) -> DataFrame:
    """``user_profile`` from ``profile_counts``."""
    keys = [*by, "user"]
    sizes = counts.where("word IS NULL").select(
        *keys, F.col("n").alias("message_count"), (F.col("chars") / F.col("n")).alias("avg_length")
    )
    words = counts.where("word IS NOT NULL").select(*keys, "word", "n")
    best = top_k(words, [F.desc("n"), F.asc("word")], n_words, keys)
    listed = best.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("word", "n")),
            lambda a, b: F.when(a["n"] > b["n"], -1)
            .when(a["n"] < b["n"], 1)
            .when(a["word"] < b["word"], -1)
            .otherwise(1),
        ).alias("common_words")
    )
    return sizes.join(listed, keys, "left")
