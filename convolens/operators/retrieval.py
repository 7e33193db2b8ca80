"""Messages by user and by recency, and the columns of a search hit."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.operators.ranking import top_k

# --- fixed values -------------------------------------------------------------------------------
LIMIT = 10
HOURS = 24
BY_USER = "user_filter"
BY_TIME = "recent"
# -------------------------------------------------------------------------------------------------

HIT_COLUMNS = ["chat_id", "seq", "user", "date_time", "message", "message_type", "score", "method"]


def user_messages(
    messages: DataFrame, username: str, limit: int = LIMIT, literal: bool = False
) -> DataFrame:
    """Latest messages whose user matches a case-insensitive pattern.

    ``literal`` takes the name as plain text. Rows without a time are never among the latest.
    """
    pattern = re.sub(r"([^\w\s])", r"\\\1", username) if literal else username
    return _latest(messages.where(F.col("user").rlike(f"(?iu){pattern}")), limit, BY_USER)


def recent_messages(
    messages: DataFrame,
    hours: int = HOURS,
    limit: int = LIMIT,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Latest messages of the last ``hours`` before ``as_of`` (the present by default)."""
    cutoff = (as_of or dt.datetime.now()) - dt.timedelta(hours=hours)
    since = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    return _latest(messages.where(F.col("date_time") >= since), limit, BY_TIME)


def _latest(messages: DataFrame, limit: int, method: str) -> DataFrame:
    timed = messages.where(F.col("message").isNotNull() & F.col("date_time").isNotNull())
    latest = top_k(timed, [F.desc("date_time"), F.asc("chat_id"), F.asc("seq")], limit)
    return latest.withColumns({"score": F.lit(1.0), "method": F.lit(method)}).select(*HIT_COLUMNS)
