"""Semantic, keyword, TF-IDF and fused search.

Every search takes a table of requests, ``(query_id string, text string)`` or
``(query_id string, vector array<float>)``, and returns ``(query_id, chat_id, seq, score)``. A single
question is a table of one row. ``render`` adds the message columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.functions.arrays import run_lengths
from convolens.functions.vectors import matrix, unit_rows
from convolens.operators.best import Best
from convolens.operators.embed import embed
from convolens.operators.index import NGRAMS
from convolens.operators.lexical import best_messages, listed, merged
from convolens.operators.ranking import DIGITS, FUSED_DIGITS, score, top_k
from convolens.operators.retrieval import HIT_COLUMNS
from convolens.runtime import BROADCAST_ROWS, FILTER_VALUES, failed_job, join_small, keep_keys, stored

# --- fixed values -------------------------------------------------------------------------------
TOP_K = 15
SEMANTIC_FLOOR = 0.1
TFIDF_FLOOR = 0.01
EXACT_WEIGHT = 2.0
FUZZY_WEIGHT = 0.8
FUZZY_FLOOR = 0.5
MIN_KEYWORD_LENGTH = 2
SEMANTIC, KEYWORD, TFIDF = "semantic_optimized", "keyword_optimized", "tfidf_optimized"
COMBINED = "combined_optimized"
METHOD_WEIGHTS = {SEMANTIC: 1.0, KEYWORD: 0.8, TFIDF: 0.6}
OTHER_WEIGHT = 0.5
METHOD_BOOST = 0.1
# -------------------------------------------------------------------------------------------------

# Queries that go to the tasks with the plan, and the blocks in which more of them meet vectors.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 50_000
# Most scores a task holds at a time.
SCORES = 4_000_000


def one_query(spark: SparkSession, query: str, query_id: str = "q") -> DataFrame:
    return spark.createDataFrame([(query_id, query)], "query_id string, text string")


def keyword_query(spark: SparkSession, keywords: str | Sequence[str]) -> DataFrame:
    """Keywords given as one string (split at white space) or as a list (kept as they are)."""
    if isinstance(keywords, str):
        return one_query(spark, keywords)
    rows = [("q", [k.lower() for k in keywords])]
    return spark.createDataFrame(rows, "query_id string, keywords array<string>")


def asked(queries: DataFrame) -> DataFrame:
    """Requests that ask for something; blank ones have no result."""
    return queries.where(F.col("text").isNotNull() & ~text.is_blank(F.col("text")))


# --- semantic -----------------------------------------------------------------------------------


def semantic_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    floor: float = SEMANTIC_FLOOR,
    ids: Sequence[str] = ("chat_id", "seq"),
    vector_col: str = "vector",
) -> DataFrame:
    """Messages by cosine to each query vector, above ``floor``.

    The scan is brute force, as an exact search has to be, but no pair table is built: each task
    multiplies its Arrow batches with a block of queries and keeps ``k`` rows per query, and only
    those are shuffled. One block of queries goes to the tasks with the plan. More queries stay a
    table: blocks of them meet blocks of vectors by key, so the driver never holds them.
    """
    asked_for = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    columns = vectors.where(F.col(vector_col).isNotNull()).select(*ids, F.col(vector_col).alias("_v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _fields(vectors, ids))
    schema = f"query_id string, {schema}, score double"
    block = asked_for.limit(QUERY_BLOCK + 1).collect()
    if not block:
        return vectors.sparkSession.createDataFrame([], schema)
    if len(block) <= QUERY_BLOCK:
        names = [r["query_id"] for r in block]
        targets = _targets(matrix(pa.array([r["vector"] for r in block], pa.list_(pa.float64()))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(names, k, floor, list(ids))
            for batch in batches:
                _add_vectors(best, batch, targets)
            yield from best.batches()

        candidates = columns.mapInArrow(scan, schema)
    else:
        candidates = _grid(columns, asked_for, k, floor, list(ids), schema)
    return top_k(candidates, _best_first(ids), k, ["query_id"])


def _targets(queries: np.ndarray) -> np.ndarray:
    return unit_rows(queries).T


def _grid(
    columns: DataFrame, queries: DataFrame, k: int, floor: float, ids: list[str], schema: str
) -> DataFrame:
    """Best rows of every block of vectors for every block of queries."""
    queries, columns = stored(queries), stored(columns)
    tall = max(1, ceil(queries.count() / QUERY_BLOCK))
    wide = max(1, ceil(columns.count() / VECTOR_BLOCK))
    block = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", block(["query_id", "vector"], tall)).select("*", every(wide).alias("_b"))
    v = columns.withColumn("_b", block(ids, wide)).select("*", every(tall).alias("_q"))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = asked.column("query_id").to_pylist()
        best = Best(names, k, floor, ids)
        if len(names) and len(rows):
            targets = _targets(matrix(asked.column("vector")))
            for batch in rows.select([*ids, "_v"]).combine_chunks().to_batches():
                _add_vectors(best, batch, targets)
        fields = [pa.field("query_id", pa.string()), *[rows.schema.field(c) for c in ids]]
        empty = pa.schema([*fields, pa.field("score", pa.float64())]).empty_table()
        return pa.concat_tables([empty, *map(pa.Table.from_batches, ([b] for b in best.batches()))])

    return v.groupBy("_q", "_b").cogroup(q.groupBy("_q", "_b")).applyInArrow(meet, schema)


def _fields(df: DataFrame, names: Sequence[str]):
    return [df.schema[n] for n in names]


def _best_first(ids: Sequence[str]) -> list[Column]:
    return [F.desc("score"), *[F.asc(c) for c in ids]]


def _add_vectors(best: Best, batch: pa.RecordBatch, targets: np.ndarray) -> None:
    """Rows of ids and, last, a vector, multiplied with the queries' unit vectors."""
    rows = matrix(batch.column(batch.num_columns - 1))
    if not rows.size:
        return
    rows = unit_rows(rows)
    table = pa.Table.from_batches([batch]).select(best.ids)
    step = max(1, SCORES // max(1, targets.shape[1]))
    for start in range(0, len(rows), step):
        # -0.0 would rank apart from 0.0.
        scores = np.round(rows[start : start + step] @ targets, DIGITS) + 0.0
        best.take(table.slice(start, step), scores)


def emotion_search(
    scored: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    floor: float = SEMANTIC_FLOOR,
    ids: Sequence[str] = ("chat_id", "seq"),
) -> DataFrame:
    """Messages whose emotion profile points the same way as the query's."""
    return semantic_search(scored, queries, k, floor, ids, vector_col="emotion_similarities")


# --- keyword ------------------------------------------------------------------------------------


def keywords_of(queries: DataFrame) -> DataFrame:
    """``(query_id, keyword, times)``; a repeated keyword counts again."""
    if "keywords" in queries.columns:
        listed = queries.select("query_id", F.explode("keywords").alias("keyword"))
    else:
        listed = asked(queries).select(
            "query_id", F.explode(text.words(F.lower("text"))).alias("keyword")
        )
    return (
        listed.select("query_id", text.strip(F.lower("keyword")).alias("keyword"))
        .where(F.length("keyword") >= MIN_KEYWORD_LENGTH)
        .groupBy("query_id", "keyword")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def letter_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def fuzzy_vocabulary(keywords: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(keyword, word, similarity)`` for index words that contain a keyword or lie in one."""
    inside = F.col("word").contains(F.col("keyword")) | F.col("keyword").contains(F.col("word"))
    pairs = fuzzy_candidates(keywords, vocabulary).where(inside & (F.col("keyword") != F.col("word")))
    scored = pairs.withColumn("similarity", letter_overlap(F.col("keyword"), F.col("word")))
    return scored.where(F.col("similarity") > FUZZY_FLOOR)


def fuzzy_candidates(keywords: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(keyword, word)`` that may be similar enough, without comparing every two.

    A text that lies in another shares its letter n-grams, and its letters are letters of the other:
    the similarity is the ratio of their numbers of distinct letters. So both containments are
    equi-joins on an n-gram and a number of distinct letters within the bound. A keyword is looked
    up by the one of its n-grams that the fewest words have, and not at all if no word has one of
    them; a word in a keyword by its first three letters (two where it has only two).
    """
    letters = lambda c: F.size(F.array_distinct(F.split(c, ""))).alias("letters")
    grams = lambda c: F.explode(F.array_union(_letter_ngrams(c, 2), _letter_ngrams(c, 3))).alias("gram")
    own = stored(keywords.select("keyword", letters("keyword")).distinct().select("keyword", "letters", grams("keyword")))
    vocab = vocabulary.select("word", letters("word"))
    wanted = own.select("gram").distinct().withColumn("known", F.lit(True))
    met = stored(join_small(vocab.select("word", "letters", grams("word")), wanted, ["gram"], ["word"]))
    often = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r")
    whole = own.where(F.length("gram") == F.least(F.length("keyword"), F.lit(3)))
    heads = whole.join(often, "gram", "left").groupBy("keyword", "letters").agg(rarest).where("r.n > 0")
    # The containing text has fewer letters than this.
    fewer = F.ceil(F.col("letters") / FUZZY_FLOOR).cast("int") - 1
    # The request's side is small and counted: store it, so that a count costs nothing.
    heads = stored(heads.select("keyword", F.col("r.gram").alias("gram"), F.explode(F.sequence("letters", fewer)).alias("letters")))
    longer = join_small(met, heads, ["gram", "letters"], ["word"])
    least = F.floor(F.col("letters") * FUZZY_FLOOR).cast("int") + 1
    around = stored(own.select("keyword", "gram", F.explode(F.sequence(least, F.col("letters"))).alias("letters")))
    starts = vocab.select("word", "letters", F.substring("word", 1, 3).alias("gram"))
    shorter = join_small(starts, around, ["gram", "letters"], ["word"])
    outer = longer.where(F.length("word") > F.length("keyword")).select("keyword", "word")
    inner = shorter.where(F.length("word") < F.length("keyword")).select("keyword", "word")
    return outer.unionByName(inner)


def _letter_ngrams(col: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(col) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(F.col(col), i, F.lit(n)))


def keyword_weights(keywords: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(query_id, word, weight)``: what each index word adds to a message that has it."""
    # A keyword that every request has is split by request.
    each = lambda small: join_small(keywords, small, ["keyword"], spread_by=["query_id"])
    listed = keywords.select("keyword").distinct()
    indexed = listed.join(vocabulary.select(F.col("word").alias("keyword")), "keyword", "left_semi")
    exact = each(indexed).select(
        "query_id", F.col("keyword").alias("word"), (F.col("times") * EXACT_WEIGHT).alias("w")
    )
    fuzzy = each(stored(fuzzy_vocabulary(keywords, vocabulary))).select(
        "query_id", "word", (F.col("times") * F.col("similarity") * FUZZY_WEIGHT).alias("w")
    )
    return exact.unionByName(fuzzy).groupBy("query_id", "word").agg(F.sum("w").alias("weight"))


def keyword_search(
    postings: DataFrame,
    vocabulary: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    words: DataFrame | None = None,
    merge: bool = False,
) -> DataFrame:
    """Messages by exact and partial keyword matches.

    The fuzzy step runs on the vocabulary. ``words`` are the messages with the list of their words,
    ``(chat_id, seq, keys)``: many keywords read those once, without a shuffle; few read their
    postings only. ``merge`` makes rows of ``words`` that share an id one message, as postings do.
    """
    weights = stored(keyword_weights(keywords_of(queries), vocabulary))
    return _scored(postings, "word", None, words, weights, k, merge=merge)


def _scored(
    rows: DataFrame,
    key: str,
    weight: str | None,
    lists: DataFrame | None,
    asked_for: DataFrame,
    k: int,
    floor: float = 0.0,
    merge: bool = False,
) -> DataFrame:
    """Messages by the sum over their keys of their weight times the request's.

    ``rows`` has a row per message and key and is sorted by key, ``lists`` (if there is one) a row
    per message. Both hold the same; few keys are looked up in the one, many in the other.
    """
    values = [r[0] for r in asked_for.select(key).distinct().limit(FILTER_VALUES + 1).collect()]
    if len(values) <= FILTER_VALUES:
        lists = listed(rows.where(F.col(key).isin(values)), key, weight)
    elif lists is None:
        lists = listed(rows.where(F.col(key).isNotNull()), key, weight)
    elif merge:
        lists = merged(lists)
    found = best_messages(lists, asked_for.withColumnRenamed(key, "key"), k, floor)
    return top_k(found, _best_first(["chat_id", "seq"]), k, ["query_id"])


def _ranked(hits: DataFrame, total: Column, k: int, floor: float | None = None) -> DataFrame:
    scored = hits.groupBy("query_id", "chat_id", "seq").agg(total.alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") > floor)
    return top_k(scored, _best_first(["chat_id", "seq"]), k, ["query_id"])


# --- TF-IDF -------------------------------------------------------------------------------------


def query_terms(
    queries: DataFrame, vocabulary: DataFrame, ngram_range: tuple[int, int] = NGRAMS
) -> DataFrame:
    """``(query_id, term, qweight)``: the query in the fitted space, with norm one."""
    grams = text.ngrams(text.tokens(F.col("text")), *ngram_range)
    counts = (
        asked(queries)
        .select("query_id", F.inline(run_lengths(grams)))
        .select("query_id", F.col("value").alias("term"), F.col("n").alias("tf"))
    )
    raw = join_small(counts, vocabulary.select("term", "idf"), ["term"], spread_by=["query_id"]).select(
        "query_id", "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    gathered = raw.groupBy("query_id").agg(
        F.collect_list(F.struct("term", "w")).alias("terms"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    return gathered.select("query_id", "norm", F.inline("terms")).select(
        "query_id", "term", (F.col("w") / F.col("norm")).alias("qweight")
    )


def tfidf_search(
    weights: DataFrame,
    vocabulary: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    floor: float = TFIDF_FLOOR,
    ngram_range: tuple[int, int] = NGRAMS,
    lists: DataFrame | None = None,
    merge: bool = False,
) -> DataFrame:
    """Messages by the dot product of normalised TF-IDF weights.

    ``lists`` are the same weights with a row per message, ``(chat_id, seq, keys, weights)``;
    ``merge`` makes those that share an id one message, as ``weights`` do.
    """
    terms = stored(query_terms(queries, vocabulary, ngram_range).withColumnRenamed("qweight", "weight"))
    return _scored(weights, "term", "weight", lists, terms, k, floor, merge)


# --- fusion -------------------------------------------------------------------------------------


@dataclass
class SearchTables:
    """What the searches read. ``vectors`` holds ``(chat_id, seq, vector)``.

    ``words`` and ``lists`` hold postings and weights once more with a row per message, for many
    requests at a time.

    ``encode`` adds the vector of a text column as it was made for ``vectors``.
    """

    messages: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    terms: DataFrame
    weights: DataFrame
    vectors: DataFrame
    words: DataFrame | None = None
    lists: DataFrame | None = None
    ngram_range: tuple[int, int] = NGRAMS
    encode: Callable[[DataFrame, str], DataFrame] = embed

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        return self.encode(asked(queries), "text").select("query_id", "vector")


def fuse(
    branches: dict[str, DataFrame],
    k: int = TOP_K,
    method_weights: dict[str, float] = METHOD_WEIGHTS,
) -> DataFrame:
    """Weighted mean of the branch scores plus a boost per branch; the best ``2 * k`` stay."""
    weight = lambda name: F.lit(method_weights.get(name, OTHER_WEIGHT))
    hits = None
    for name, found in branches.items():
        part = found.select("query_id", "chat_id", "seq", "score", weight(name).alias("weight"))
        hits = part if hits is None else hits.unionByName(part)
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    # A branch lists a message at most once per query, so rows count branches.
    fused = score(mean + METHOD_BOOST * F.count(F.lit(1)), FUSED_DIGITS)
    return _ranked(hits, fused, 2 * k)


def branches_of(
    tables: SearchTables, queries: DataFrame, k: int = TOP_K, query_vectors: DataFrame | None = None
) -> dict[str, Callable[[], DataFrame]]:
    """The three searches of a fused search, each to be planned by itself."""

    def semantic() -> DataFrame:
        vectors = tables.query_vectors(queries) if query_vectors is None else query_vectors
        return semantic_search(tables.vectors, vectors, k)

    def keyword() -> DataFrame:
        return keyword_search(tables.postings, tables.vocabulary, queries, k, tables.words)

    def tfidf() -> DataFrame:
        return tfidf_search(tables.weights, tables.terms, queries, k, ngram_range=tables.ngram_range, lists=tables.lists)

    return {SEMANTIC: semantic, KEYWORD: keyword, TFIDF: tfidf}


def combined_search(
    tables: SearchTables,
    queries: DataFrame,
    k: int = TOP_K,
    query_vectors: DataFrame | None = None,
    method_weights: dict[str, float] = METHOD_WEIGHTS,
) -> DataFrame:
    """Semantic, keyword and TF-IDF search in one plan, fused.

    ``query_vectors`` are the queries in the space of ``tables.vectors``, encoded like those by
    default.
    """
    planned = {name: run() for name, run in branches_of(tables, queries, k, query_vectors).items()}
    return fuse(planned, k, method_weights)


STATUS = "branch string, error string"


def attempted(branches: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run every branch by itself and store it: the results there are, and why others failed.

    Errors of a plan, which are the program's, are raised.
    """
    found, failed = {}, {}
    for name, run in branches.items():
        try:
            found[name] = stored(run())
        except Exception as e:
            why = failed_job(e)
            if why is None:
                raise
            failed[name] = why
    return found, failed


def combined_search_by_branch(
    tables: SearchTables,
    queries: DataFrame,
    k: int = TOP_K,
    query_vectors: DataFrame | None = None,
    method_weights: dict[str, float] = METHOD_WEIGHTS,
) -> tuple[DataFrame, DataFrame]:
    """``combined_search`` where a failing branch costs only itself, and ``(branch, error)``.

    Each branch is computed and stored first; the fusion takes what is there, so a message found by
    two branches of three counts as one found by two. The status has a row per branch, with a null
    error for those that took part.
    """
    spark = queries.sparkSession
    found, failed = attempted(branches_of(tables, queries, k, query_vectors))
    status = spark.createDataFrame([(m, failed.get(m)) for m in METHOD_WEIGHTS], STATUS)
    if not found:
        return spark.createDataFrame([], "query_id string, chat_id string, seq long, score double"), status
    return fuse(found, k, method_weights), status


def render(hits: DataFrame, messages: DataFrame, method: str, bound: int | None = None) -> DataFrame:
    """Hits with their message columns.

    ``bound`` is the number of hits there can be (queries times k) where the caller knows it; the
    hits are then broadcast and the messages are scanned without a shuffle. For a few hits the
    scan is also limited to their chats.
    """
    columns = messages.select("chat_id", "seq", "user", "date_time", "message", "message_type")
    if bound is not None and bound <= FILTER_VALUES:
        hits = stored(hits)
        columns = keep_keys(columns, hits, "chat_id")
    small = bound is not None and bound <= BROADCAST_ROWS
    return (
        columns.join(F.broadcast(hits) if small else hits, ["chat_id", "seq"])
        .withColumn("method", F.lit(method))
        .select("query_id", *HIT_COLUMNS)
    )
