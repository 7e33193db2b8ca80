"""The behaviour report: every statistic at once, as tables or as one long table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.operators import stats
from convolens.operators.gaps import WINDOW_ROWS
from convolens.runtime import stored


def report(
    messages: DataFrame,
    lexicon: DataFrame,
    by: Sequence[str] = (),
    max_group_rows: int = WINDOW_ROWS,
    stop_words: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per metric, keyed by the metric's name.

    The messages that count are stored first with the columns that are needed, so the source is
    scanned once. Response time and silence share one time-ordered pass.
    """
    needed = dict.fromkeys([*by, "chat_id", "seq", "date_time", "user", "message"])
    messages = stored(stats.reportable(messages).select(*needed))
    gaps = stats.gap_stats(messages, by, max_group_rows)
    wake = stats.wake_sleep(messages, by)
    return {
        "per_user_stats": stats.user_activity(messages, by),
        "emoji_counts": stats.emoji_counts(messages, by),
        "avg_sentiment": stats.sentiment_by_user(messages, lexicon, by),
        "gaps": gaps,
        "top_words": stats.top_words(messages, by, stop_words=stop_words),
        "wake_sleep_pattern": wake,
        "dominance_score": stats.dominance(messages, by),
    }


# Metric name -> (report table, key column, value column).
LONG_FORM = {
    "total_messages": ("per_user_stats", "user", "total_messages"),
    "total_words": ("per_user_stats", "user", "total_words"),
    "avg_words": ("per_user_stats", "user", "avg_words"),
    "avg_chars": ("per_user_stats", "user", "avg_chars"),
    "avg_caps_ratio": ("per_user_stats", "user", "avg_caps_ratio"),
    "emoji_counts": ("emoji_counts", "emoji", "n"),
    "avg_sentiment": ("avg_sentiment", "user", "avg_sentiment"),
    "avg_response_time_sec": ("gaps", "user", "avg_response_sec"),
    "longest_silence_seconds": ("gaps", "user", "longest_silence_sec"),
    "top_words": ("top_words", "word", "n"),
    "avg_first_msg_hour": ("wake_sleep_pattern", "user", "avg_first_hour"),
    "avg_last_msg_hour": ("wake_sleep_pattern", "user", "avg_last_hour"),
    "dominance_score": ("dominance_score", "user", "share"),
}


def report_long(tables: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, metric, key, value)`` over all metrics.

    Metrics of one table are unpivoted together, so each statistic is computed once.
    """
    grouped: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for metric, (table, key, value) in LONG_FORM.items():
        grouped.setdefault((table, key), []).append((metric, value))
    parts = [
        tables[table].select(
            *by,
            F.col(key).alias("key"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric"), F.col(v).cast("double").alias("value"))
                        for m, v in metrics
                    ]
                )
            ),
        )
        for (table, key), metrics in grouped.items()
    ]
    return reduce(DataFrame.unionByName, parts).select(*by, "metric", "key", "value")
