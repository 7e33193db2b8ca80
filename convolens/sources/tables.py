"""Message tables as CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.schema import MESSAGE_SCHEMA, as_messages

# Reading and writing share these, so empty bodies, quotes and blanks survive.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


TEXT_COLUMNS = ["chat_id", "user", "message_type", "message"]
# Line ends, and the backslash that marks them, as two characters each.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def _escaped(col: str) -> Column:
    """Line ends as two characters. Only texts with one, or that look escaped, are marked so by a
    backslash in front; all others stay as they are."""
    out = F.col(col)
    for plain, escaped in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    special = F.col(col).rlike(r"[\n\r]|^\\")
    return F.when(special, F.concat(F.lit("\\"), out)).otherwise(F.col(col))


def _unescaped(col: str) -> Column:
    out = F.replace(F.substring(F.col(col), 2, 1 << 30), F.lit("\\\\"), F.lit("\0"))
    for plain, escaped in ESCAPES[1:]:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.when(F.col(col).startswith("\\"), F.replace(out, F.lit("\0"), F.lit("\\"))).otherwise(F.col(col))


def write_message_csv(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write messages with one line each, so that large files can be split when they are read.

    A text with line ends starts with a backslash and has them as ``\\n`` and ``\\r``; a text that
    starts with a backslash is treated alike. NUL characters are not kept in such texts.
    """
    plain = as_messages(messages).select(*MESSAGE_SCHEMA.fieldNames())
    escaped = plain.withColumns({c: _escaped(c) for c in TEXT_COLUMNS})
    escaped.write.options(**CSV_OPTIONS).mode(mode).csv(path)


def read_message_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    reference_nulls: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read a message CSV with its fixed schema.

    ``multi_line`` reads foreign files with line ends inside quotes, one task per file, and takes
    texts as they stand. ``reference_nulls`` turns empty fields into nulls, so media messages fall
    out of everything that drops null bodies.
    """
    reader = spark.read.schema(MESSAGE_SCHEMA).options(**CSV_OPTIONS).option("multiLine", multi_line)
    df = reader.csv(path)
    if not multi_line:
        df = df.withColumns({c: _unescaped(c) for c in TEXT_COLUMNS})
    if reference_nulls:
        empty = lambda c: F.when(F.col(c) != "", F.col(c))
        df = df.withColumns({c: empty(c) for c in ("user", "message_type", "message")})
    return df


def write_message_table(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, partitioned as the messages come in: no shuffle, and no file per chat."""
    as_messages(messages).write.mode(mode).parquet(path)


def read_message_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return as_messages(spark.read.parquet(*paths))
