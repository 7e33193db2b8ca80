"""Behaviour statistics. ``by=()`` treats the table as one chat, ``by=("chat_id",)`` as many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.operators.gaps import WINDOW_ROWS, answered, next_message
from convolens.operators.index import word_postings
from convolens.operators.ranking import top_k
from convolens.operators.sentiment import message_sentiment

By = Sequence[str]

# --- fixed values -------------------------------------------------------------------------------
TOP_USERS = 5
COMMON_WORDS = 20
TOP_EMOJIS = 10
TOP_WORDS = 20
# -------------------------------------------------------------------------------------------------


def reportable(messages: DataFrame) -> DataFrame:
    """Messages with something in them; the report ignores null and blank bodies."""
    return messages.where(F.col("message").isNotNull() & ~text.is_blank(F.col("message")))


def _known(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("user").isNotNull())


def dataset_stats(messages: DataFrame, by: By = ()) -> DataFrame:
    return (
        messages.where(F.col("message").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count_distinct("user").alias("unique_users"),
            F.min("date_time").alias("first_time"),
            F.max("date_time").alias("last_time"),
            F.avg(F.length("message")).alias("avg_message_length"),
        )
    )


def type_counts(messages: DataFrame, by: By = ()) -> DataFrame:
    kept = messages.where(F.col("message").isNotNull() & F.col("message_type").isNotNull())
    return kept.groupBy(*by, "message_type").agg(F.count(F.lit(1)).alias("n"))


def top_users(messages: DataFrame, by: By = (), n: int = TOP_USERS) -> DataFrame:
    kept = _known(messages.where(F.col("message").isNotNull()))
    counts = kept.groupBy(*by, "user").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("user")], n, by)


def common_words(messages: DataFrame, by: By = (), n: int = COMMON_WORDS) -> DataFrame:
    """Words by the number of messages that contain them."""
    counts = word_postings(messages).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("df"))
    return top_k(counts, [F.desc("df"), F.asc("word")], n, by)


def user_activity(messages: DataFrame, by: By = ()) -> DataFrame:
    body = F.col("message")
    per_message = _known(reportable(messages)).select(
        *by,
        "user",
        text.word_count(body).alias("words"),
        text.char_count(body).alias("chars"),
        text.caps_ratio(body).alias("caps"),
    )
    return per_message.groupBy(*by, "user").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.sum("words").alias("total_words"),
        F.avg("words").alias("avg_words"),
        F.avg("chars").alias("avg_chars"),
        F.avg("caps").alias("avg_caps_ratio"),
    )


def emoji_counts(messages: DataFrame, by: By = (), n: int = TOP_EMOJIS) -> DataFrame:
    found = reportable(messages).select(*by, F.explode(text.emojis(F.col("message"))).alias("emoji"))
    counts = found.groupBy(*by, "emoji").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("emoji")], n, by)


def sentiment_by_user(
    messages: DataFrame, lexicon: DataFrame, by: By = (), rules: bool = False, emphasis: bool = False
) -> DataFrame:
    """Mean message sentiment per user; the options are those of ``message_sentiment``."""
    scores = message_sentiment(_known(messages), lexicon, by, rules, emphasis)
    return scores.groupBy(*by, "user").agg(F.avg("sentiment").alias("avg_sentiment"))


def gap_stats(messages: DataFrame, by: By = (), max_group_rows: int = WINDOW_ROWS) -> DataFrame:
    """Mean and longest time until someone else writes next, credited to the earlier author.

    Only the ordering columns and the author go through the time-order shuffle.
    """
    columns = dict.fromkeys([*by, "chat_id", "seq", "date_time", "user"])
    gaps = answered(next_message(reportable(messages).select(*columns), by, max_group_rows))
    return gaps.groupBy(*by, "user").agg(
        F.coalesce(F.avg("gap_sec"), F.lit(0.0)).alias("avg_response_sec"),
        F.coalesce(F.max("gap_sec"), F.lit(0.0)).alias("longest_silence_sec"),
    )


def response_time(
    messages: DataFrame, by: By = (), max_group_rows: int = WINDOW_ROWS
) -> DataFrame:
    return gap_stats(messages, by, max_group_rows).drop("longest_silence_sec")


def longest_silence(
    messages: DataFrame, by: By = (), max_group_rows: int = WINDOW_ROWS
) -> DataFrame:
    return gap_stats(messages, by, max_group_rows).drop("avg_response_sec")


def top_words(
    messages: DataFrame,
    by: By = (),
    n: int = TOP_WORDS,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """Most frequent tokens without stop words."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    toks = reportable(messages).select(*by, F.explode(text.tokens(F.col("message"))).alias("word"))
    counts = toks.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(~F.col("word").isin(list(stop_words))) if stop_words else counts
    return top_k(kept, [F.desc("n"), F.asc("word")], n, by)


def wake_sleep(messages: DataFrame, by: By = ()) -> DataFrame:
    """Mean hour of a user's first and last message of the day."""
    days = (
        _known(reportable(messages))
        .where(F.col("date_time").isNotNull())
        .groupBy(*by, F.to_date("date_time").alias("date"), "user")
        .agg(F.min(F.hour("date_time")).alias("first"), F.max(F.hour("date_time")).alias("last"))
    )
    return days.groupBy(*by, "user").agg(
        F.avg("first").alias("avg_first_hour"), F.avg("last").alias("avg_last_hour")
    )


def dominance(messages: DataFrame, by: By = ()) -> DataFrame:
    """Each user's share of the messages."""
    kept = _known(reportable(messages))
    counts = kept.groupBy(*by, "user").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        total = kept.agg(F.count(F.lit(1)).alias("total")).scalar()
        return counts.select("user", (F.col("n") / total).alias("share"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(by)).select(
        *by, "user", (F.col("n") / F.col("total")).alias("share")
    )


def emotion_mix(labelled: DataFrame, by: By = ()) -> DataFrame:
    """Messages per user and dominant emotion."""
    kept = _known(labelled).where(F.col("dominant_emotion").isNotNull())
    return kept.groupBy(*by, "user", "dominant_emotion").agg(F.count(F.lit(1)).alias("n"))


def calendar_profile(messages: DataFrame, by: By = ()) -> DataFrame:
    """Message counts by date, weekday and hour."""
    parts = text.calendar(F.col("date_time"))
    timed = reportable(messages).where(F.col("date_time").isNotNull())
    return timed.groupBy(*by, *[c.alias(n) for n, c in parts.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )
