"""The message-table contract shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("chat_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("date_time", T.TimestampNTZType()),
        T.StructField("user", T.StringType()),
        T.StructField("message_type", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# (chat_id, seq) identifies a message; seq orders the messages of one chat.
ID = ("chat_id", "seq")


def as_messages(df: DataFrame) -> DataFrame:
    """Check a caller's table against the contract and cast it to the exact types.

    Extra columns (for example ``message_raw``) are kept after the contract columns.
    """
    missing = [f.name for f in MESSAGE_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"not a message table, missing columns: {missing}")
    extra = [c for c in df.columns if c not in MESSAGE_SCHEMA.fieldNames()]
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE_SCHEMA], *extra
    )


def empty_messages(spark) -> DataFrame:
    return spark.createDataFrame([], MESSAGE_SCHEMA)
