"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import datetime as dt
import importlib
import importlib.util
import os
import shutil
import sys
import tempfile
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from convolens import fixtures as fx
from convolens.functions import text
from convolens.operators import embed as em
from convolens.operators import index, responses, retrieval, search, stats
from convolens.operators.gaps import next_message
from convolens.operators.ranking import score
from convolens.plans import report as rp
from convolens.plans import router
from convolens.runtime import scratch_path
from convolens.runtime import stored as keep
from convolens.sources import export, index_store, tables

# The subpackage is optional; what goes wrong inside it must show.
_there = importlib.util.find_spec("convolens.llm") and importlib.util.find_spec("convolens.llm.queries")
llm = importlib.import_module("convolens.llm.queries") if _there else None

CHAT = ("chat_id",)
AS_OF = dt.datetime.fromisoformat(fx.AS_OF)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers the package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="convolens-"), "convolens")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "convolens"))
        _shipped.add(app)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: fused semantic, keyword and TF-IDF search over all conversations."""
    return queries()["combined_search"](spark, "/root/testdata/sf0.001")


# --- sources and parsing --------------------------------------------------------------------------


def write_export(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "export")
    fx.export_lines(spark, sf_dir).select("value").write.text(path)
    return path


def ingest_export(spark, sf_dir):
    df = export.read_export(spark, write_export(spark, sf_dir), line_join="\n")
    return df.select("date_time", "user", "message_type", "message")


def ingest_reference_export(spark, sf_dir):
    """Files cut in reference mode by chained splits, as if every file were large."""
    path = write_export(spark, sf_dir)
    df = export.read_export(spark, path, "\n", "reference", whole_file_bytes=0)
    return df.select("date_time", "user", "message_type", "message")


def ingest_large_export(spark, sf_dir):
    path = write_export(spark, sf_dir)
    df = export.read_export(spark, path, line_join="\n", whole_file_bytes=0)
    return df.select("date_time", "user", "message_type", "message")


def _parse(spark, sf_dir, mode, line_join):
    texts = fx.exports(spark, sf_dir).withColumn(
        "text", export.join_lines(F.col("text"), line_join)
    )
    df = export.parse_export(texts, mode)
    return df.select("chat_id", "date_time", "user", "message_type", "message")


def parse_export(spark, sf_dir):
    return _parse(spark, sf_dir, "lossless", "\n")


def parse_export_reference(spark, sf_dir):
    return _parse(spark, sf_dir, "reference", "")


def _classified(spark, sf_dir):
    bodies = fx.export_bodies(spark, sf_dir)
    plain = text.normalize_body(export.join_lines(F.col("body"), "\n"))
    return bodies.select("chat_id", "seq", export.classify(plain).alias("t")).select(
        "chat_id", "seq", "t.message_type", "t.message"
    )


def classify_type(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("message_type").agg(F.count(F.lit(1)).alias("n"))


def call_details(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.col("message_type").endswith(" Call"))


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    tables.write_message_csv(fx.messages(spark, sf_dir), path)
    return tables.read_message_csv(spark, path)


def table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "table")
    tables.write_message_table(fx.document_messages(spark, sf_dir), path)
    return tables.read_message_table(spark, path)


def clean_text(spark, sf_dir):
    return index.indexable(fx.rich_messages(spark, sf_dir)).select("chat_id", "seq", "clean_text")


def emoji_alias(spark, sf_dir):
    named = text.emoji_aliases(F.col("message")).alias("named")
    return fx.emoji_messages(spark, sf_dir).select("chat_id", "seq", named)


# --- statistics -----------------------------------------------------------------------------------

ACTIVITY = ["avg_words", "avg_chars", "avg_caps_ratio"]


def report_long(spark, sf_dir):
    parts = rp.report(fx.messages(spark, sf_dir), fx.lexicon(spark), stop_words=fx.STOP_WORDS)
    return rounded(rp.report_long(parts), "value")


def _gaps(messages, by, **options):
    return rounded(
        next_message(stats.reportable(messages), by, **options).select(
            "chat_id", "seq", "user", "date_time", "next_user", "next_time", "gap_sec"
        ),
        "gap_sec",
    )


def user_messages(spark, sf_dir):
    return retrieval.user_messages(fx.event_messages(spark, sf_dir), "^1.$")


def recent_messages(spark, sf_dir):
    return retrieval.recent_messages(fx.event_messages(spark, sf_dir), hours=36, as_of=AS_OF)


# --- index ----------------------------------------------------------------------------------------


def _vocabulary(messages):
    return rounded(index.tfidf_vocabulary(messages), "idf")


def _weights(messages):
    return rounded(index.own_weights(messages), "weight")


def index_roundtrip(spark, sf_dir):
    messages = fx.messages(spark, sf_dir)
    stored = index_store.build_or_load(messages, scratch_path(spark, "index"))
    return rounded(stored.weights, "weight")


def index_uncapped(spark, sf_dir):
    """Single words only, every word kept."""
    options = index_store.IndexOptions(ngram_range=(1, 1), min_df=1, max_df=1.0, max_features=None)
    messages = fx.messages(spark, sf_dir)
    stored = index_store.build_or_load(messages, scratch_path(spark, "index"), options)
    return rounded(stored.terms, "idf")


def index_segments(spark, sf_dir):
    """The weights of an index that had the even chats first, then all of them, the odd ones anew."""
    messages, path = fx.messages(spark, sf_dir), scratch_path(spark, "index")
    odd = F.col("chat_id").cast("long") % 2 == 1
    shorter = messages.withColumn("message", F.when(odd, F.upper("user")).otherwise(F.col("message")))
    index_store.build(shorter.where(F.col("chat_id").cast("long") % 3 > 0), path)
    return rounded(index_store.build_or_load(messages, path).weights, "weight")


def user_profile(spark, sf_dir):
    profile = index.user_profile(fx.messages(spark, sf_dir))
    listed = profile.select(
        "user",
        "message_count",
        F.round("avg_length", 6).alias("avg_length"),
        F.posexplode("common_words").alias("pos", "w"),
    )
    return listed.select(
        "user", "message_count", "avg_length", "w.word", "w.n", (F.col("pos") + 1).alias("rank")
    )


def embed_hash(spark, sf_dir):
    vectors = em.embed(index.indexable(fx.messages(spark, sf_dir)), "clean_text")
    flat = vectors.select("chat_id", "seq", F.posexplode("vector").alias("pos", "v"))
    return flat.where(F.col("v") != 0).select(
        "chat_id", "seq", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v")
    )


def _scored_vectors(spark, sf_dir):
    ship(spark)
    return em.emotion_scores(fx.vectors(spark, sf_dir), "vector", fx.prototypes(spark, sf_dir))


def nearest_label(spark, sf_dir):
    best = F.array_max("emotion_similarities").alias("score")
    return _scored_vectors(spark, sf_dir).select("vec_id", "dominant_emotion", best)


def emotion_mix(spark, sf_dir):
    return stats.emotion_mix(_scored_vectors(spark, sf_dir))


def message_emotions(spark, sf_dir):
    ship(spark)
    vectors = em.embed(index.indexable(fx.messages(spark, sf_dir)), "clean_text")
    narrow = vectors.select("chat_id", "seq", "vector")
    scored = em.emotion_scores(narrow, "vector", em.emotion_labels(spark))
    best = F.array_max("emotion_similarities").alias("score")
    return scored.select("chat_id", "seq", "dominant_emotion", best)


def _mean_vector(df, column):
    """The mean of all vectors as the one query ``q``."""
    means = (
        df.select(F.posexplode(column).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    )
    return means.select(
        F.lit("q").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("vector")
    )


def emotion_similar(spark, sf_dir):
    scored = _scored_vectors(spark, sf_dir)
    query = _mean_vector(scored, "emotion_similarities")
    return search.emotion_search(scored, query, ids=["vec_id"])


# --- search ---------------------------------------------------------------------------------------


def semantic_topk(spark, sf_dir):
    ship(spark)
    vectors = fx.vectors(spark, sf_dir)
    return search.semantic_search(vectors, _mean_vector(vectors, "vector"), ids=["vec_id"])


def semantic_batch(spark, sf_dir):
    ship(spark)
    protos = fx.prototypes(spark, sf_dir).select(F.col("label").alias("query_id"), "vector")
    return search.semantic_search(fx.vectors(spark, sf_dir), protos, ids=["vec_id"])


def semantic_messages(spark, sf_dir):
    ship(spark)
    wanted = em.embed(search.asked(fx.benchmark_queries(spark, sf_dir)), "text")
    return search.semantic_search(stored(spark, sf_dir).vectors, wanted)


_versions: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> search.SearchTables:
    """Index tables of the conversations: built by the first search that needs them, then reused."""
    ship(spark)
    messages = fx.messages(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _versions:
        _versions[key] = index_store.build(messages, scratch_path(spark, "search"))
    return index_store.load(messages, _versions[key])


def keyword_search(spark, sf_dir):
    t = stored(spark, sf_dir)
    asked = search.keyword_query(spark, oracles.KEYWORDS)
    hits = search.keyword_search(t.postings, t.vocabulary, asked)
    return search.render(hits, t.messages, search.KEYWORD, bound=search.TOP_K)


def keyword_batch(spark, sf_dir):
    t = stored(spark, sf_dir)
    asked = fx.benchmark_queries(spark, sf_dir)
    return search.keyword_search(t.postings, t.vocabulary, asked, words=t.words, merge=True)


def fuzzy_vocab(spark, sf_dir):
    keywords = search.keywords_of(fx.benchmark_queries(spark, sf_dir))
    vocabulary = stored(spark, sf_dir).vocabulary
    return rounded(search.fuzzy_vocabulary(keywords, vocabulary), "similarity")


def tfidf_search(spark, sf_dir):
    t = stored(spark, sf_dir)
    hits = search.tfidf_search(t.weights, t.terms, search.one_query(spark, oracles.QUESTION))
    return search.render(hits, t.messages, search.TFIDF, bound=search.TOP_K)


def tfidf_batch(spark, sf_dir):
    t = stored(spark, sf_dir)
    return search.tfidf_search(t.weights, t.terms, fx.benchmark_queries(spark, sf_dir), lists=t.lists, merge=True)


def combined_search(spark, sf_dir):
    t = stored(spark, sf_dir)
    hits = search.combined_search(t, search.one_query(spark, oracles.QUESTION))
    return search.render(hits, t.messages, search.COMBINED, bound=2 * search.TOP_K)


def combined_batch(spark, sf_dir):
    return search.combined_search(stored(spark, sf_dir), fx.benchmark_queries(spark, sf_dir))


# --- responses ------------------------------------------------------------------------------------


def strip_reasoning(spark, sf_dir):
    df = fx.responses(spark, sf_dir)
    return df.select("conv_id", "turn", responses.strip_reasoning(F.col("response")).alias("clean"))


def tool_calls(spark, sf_dir):
    calls = responses.tool_calls(fx.responses(spark, sf_dir))
    arg = lambda n: F.try_variant_get("arguments", f"$.{n}", "string")
    return calls.select(
        "conv_id", "turn", "is_call", "name", F.coalesce(arg("query"), arg("keywords")).alias("argument")
    )


_answered: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _routed(spark, sf_dir):
    """The requests and their answers: worked out by the first query that needs them, then reused."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _answered:
        reqs = keep(router.requests(responses.tool_calls(fx.request_responses(spark, sf_dir))))
        _answered[key] = reqs, keep(router.route(reqs, stored(spark, sf_dir), as_of=AS_OF))
    return _answered[key]


def route_requests(spark, sf_dir):
    _, out = _routed(spark, sf_dir)
    part = lambda path: F.get_json_object("stats", f"$.{path}")
    return out.where(F.col("error").isNull()).select(
        "query_id", "function", "chat_id", "seq", "user", "date_time", "message", "message_type",
        "score", "method", part("total_messages").cast("long").alias("total_messages"),
        part("most_common_words").alias("most_common_words"),
    )


def route_errors(spark, sf_dir):
    reqs = router.requests(responses.tool_calls(fx.request_responses(spark, sf_dir)))
    ship(spark)
    kind = F.regexp_extract("error", "^([a-z ]+)", 1).alias("kind")
    return reqs.where(F.col("error").isNotNull()).select("query_id", "function", kind)


def _unpacked(packed):
    """The context of each request as rows again, in its order; one that cannot be read is no empty one."""
    kind = "array<struct<chat_id: string, seq: long, message: string, score: double, method: string>>"
    strict = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}
    listed = packed.select("query_id", F.posexplode(F.from_json("context", kind, strict)).alias("pos", "h"))
    return listed.select("query_id", "pos", "h.*")


def pack_context(spark, sf_dir):
    asked = fx.benchmark_queries(spark, sf_dir)
    t = stored(spark, sf_dir)
    hits = search.tfidf_search(t.weights, t.terms, asked, lists=t.lists, merge=True)
    return _unpacked(responses.pack_context(search.render(hits, t.messages, search.TFIDF), asked))


def route_context(spark, sf_dir):
    """The rows have no place for a failure, so the query fails of one; it is routed anew the next time."""
    reqs, out = _routed(spark, sf_dir)
    first = F.min(F.struct("query_id", "function", "error"))
    n, failed = router.failures(reqs, out).agg(F.count(F.lit(1)), first).first()
    if n:
        del _answered[spark.sparkContext.applicationId, sf_dir]
        raise RuntimeError(f"{n} failures while routing, the first in {failed.query_id}, {failed.function}: {failed.error}")
    return _unpacked(router.answer_contexts(reqs, out))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    msg, rich, doc, ev = fx.messages, fx.rich_messages, fx.document_messages, fx.event_messages

    def on(view, operator, *columns, **options):
        """A query that applies one operator to one message table and rounds some columns."""
        return lambda spark, sf_dir: rounded(operator(view(spark, sf_dir), **options), *columns)

    def mood(view, by):
        return lambda spark, sf_dir: rounded(
            stats.sentiment_by_user(view(spark, sf_dir), fx.lexicon(spark), by), "avg_sentiment"
        )

    def shipped(query):
        def run(spark, sf_dir):
            ship(spark)
            return query(spark, sf_dir)

        return run

    found = (llm.queries() if llm else {}) | {
        "ingest_export": ingest_export,
        "ingest_large_export": ingest_large_export,
        "ingest_reference_export": ingest_reference_export,
        "parse_export": parse_export,
        "parse_export_reference": parse_export_reference,
        "classify_type": classify_type,
        "call_details": call_details,
        "csv_roundtrip": csv_roundtrip,
        "table_roundtrip": table_roundtrip,
        "clean_text": clean_text,
        "emoji_alias": emoji_alias,
        "emoji_counts": on(rich, stats.emoji_counts),
        "calendar_profile": on(ev, stats.calendar_profile),
        "dataset_stats": on(msg, stats.dataset_stats, "avg_message_length"),
        "dataset_stats_by_chat": on(ev, stats.dataset_stats, "avg_message_length", by=CHAT),
        "type_counts": on(ev, stats.type_counts),
        "top_users": on(ev, stats.top_users),
        "top_users_by_chat": on(ev, stats.top_users, by=CHAT),
        "common_words": on(msg, stats.common_words),
        "user_activity": on(rich, stats.user_activity, *ACTIVITY),
        "user_activity_by_chat": on(doc, stats.user_activity, *ACTIVITY, by=CHAT),
        "sentiment_by_user": mood(msg, ()),
        "sentiment_by_chat": mood(doc, CHAT),
        "sentiment_rules": lambda spark, sf_dir: rounded(
            stats.sentiment_by_user(fx.mood_messages(spark, sf_dir), fx.lexicon(spark), (), rules=True),
            "avg_sentiment",
        ),
        "sentiment_emphasis": lambda spark, sf_dir: rounded(
            stats.sentiment_by_user(
                fx.emphatic_messages(spark, sf_dir), fx.lexicon(spark), (), rules=True, emphasis=True
            ),
            "avg_sentiment",
        ),
        "response_time": on(ev, stats.response_time, "avg_response_sec"),
        "response_time_by_chat": on(ev, stats.response_time, "avg_response_sec", by=CHAT),
        "longest_silence": on(ev, stats.longest_silence, "longest_silence_sec"),
        "longest_silence_by_chat": on(ev, stats.longest_silence, "longest_silence_sec", by=CHAT),
        "gaps_by_chat": on(ev, _gaps, by=CHAT),
        "gaps_by_chat_ranged": on(ev, _gaps, by=CHAT, max_group_rows=0),
        "gaps_global": on(ev, _gaps, by=()),
        "top_words": on(doc, stats.top_words, stop_words=fx.STOP_WORDS),
        "wake_sleep": on(ev, stats.wake_sleep, "avg_first_hour", "avg_last_hour"),
        "dominance": on(ev, stats.dominance, "share"),
        "dominance_by_chat": on(ev, stats.dominance, "share", by=CHAT),
        "report_long": report_long,
        "user_messages": user_messages,
        "recent_messages": recent_messages,
        "word_postings": on(msg, index.word_postings),
        "word_freq": lambda spark, sf_dir: index.word_freq(index.word_postings(doc(spark, sf_dir))),
        "tfidf_terms": on(msg, index.term_counts),
        "tfidf_vocab": on(msg, _vocabulary),
        "tfidf_vocab_documents": on(doc, _vocabulary),
        "tfidf_weights": on(msg, _weights),
        "tfidf_weights_documents": on(doc, _weights),
        "index_roundtrip": index_roundtrip,
        "index_segments": index_segments,
        "index_uncapped": index_uncapped,
        "user_profile": user_profile,
        "embed_hash": embed_hash,
        "nearest_label": nearest_label,
        "emotion_mix": emotion_mix,
        "message_emotions": message_emotions,
        "emotion_similar": emotion_similar,
        "semantic_topk": semantic_topk,
        "semantic_batch": semantic_batch,
        "semantic_messages": semantic_messages,
        "keyword_search": keyword_search,
        "keyword_batch": keyword_batch,
        "fuzzy_vocab": fuzzy_vocab,
        "tfidf_search": tfidf_search,
        "tfidf_batch": tfidf_batch,
        "combined_search": combined_search,
        "combined_batch": combined_batch,
        "strip_reasoning": strip_reasoning,
        "tool_calls": tool_calls,
        "route_requests": route_requests,
        "route_errors": route_errors,
        "route_context": route_context,
        "pack_context": pack_context,
    }
    return {name: shipped(q) for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm.oracle_sql() if llm else {})
