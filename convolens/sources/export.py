"""Chat export text: reading, cutting into messages, timestamps, types and call details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.functions.arrays import let
from convolens.functions.text import SPACE, normalize_body, strip
from convolens.schema import MESSAGE_SCHEMA
from convolens.sources import scan

# --- fixed values of the export format ----------------------------------------------------------
# [day/month/year, hour:minute:second<narrow no-break space>AM|PM]
STAMP = r"\[(\d{1,2}/\d{1,2}/\d{2}), (\d{1,2}:\d{2}:\d{2})\x{202F}([AP]M)\]"
# A whole message as one non-overlapping match: optional sender before the first colon, then at
# least one character up to the next bracket or the end.
MATCH = r"(?s)" + STAMP + r" ?(.+?)? ?: ?(.+?)(?=\[|$)"
LEFT_TO_RIGHT_MARK = "\u200e"
MEDIA_MARKERS = [
    ("image omitted", "Image"),
    ("video omitted", "Video"),
    ("sticker omitted", "Sticker"),
    ("audio omitted", "Audio"),
    ("document omitted", "Document"),
    ("contact omitted", "Contact"),
    ("location shared", "Location"),
]
CALL_MARKERS = [
    ("missed voice call, tap to call back", "voice call,", "Voice Call"),
    ("missed video call, tap to call back", "video call,", "Video Call"),
]
# Two-digit years below this belong to 20xx, the others to 19xx.
CENTURY_PIVOT = 69
# -------------------------------------------------------------------------------------------------

# Files up to this size are handled as one row; larger ones are cut while they are read.
WHOLE_FILE_BYTES = 64 << 20


def join_lines(text: Column, line_join: str = "") -> Column:
    """Strip every line, put the lines together and drop left-to-right marks.

    The reference format joins with nothing in between; ``"\\n"`` keeps line ends.
    """
    if line_join not in ("", "\n"):
        raise ValueError("line_join is '' or a line feed")
    blank = rf"[{SPACE}&&[^\r\n]]*"
    joined = F.regexp_replace(text, rf"{blank}(?:\r\n?|\n){blank}", line_join)
    return F.translate(strip(joined), LEFT_TO_RIGHT_MARK, "")


def read_export_text(
    spark: SparkSession, paths: str | Sequence[str], line_join: str = ""
) -> DataFrame:
    """``(chat_id, text)`` with one row per file; a missing path raises.

    Reading one chat per row is parallel over files and needs no shuffle. ``read_export`` is the
    entry point that also handles files too large for a single row.
    """
    raw = spark.read.text(_paths(paths), wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("chat_id"),
        join_lines(F.col("value"), line_join).alias("text"),
    )


def read_export(
    spark: SparkSession,
    paths: str | Sequence[str],
    line_join: str = "",
    mode: str = "lossless",
    whole_file_bytes: int = WHOLE_FILE_BYTES,
    **options,
) -> DataFrame:
    """Read export files into the message table, with ``chat_id`` the file's path.

    Small files take the row-per-file way. Larger files are split by the text source itself at line
    breaks, so one huge chat is read by many tasks; in reference mode, where a match depends on all
    text before it, the splits' states are chained (``scan``). ``seq`` counts a file's messages from
    0 either way.
    """
    if mode not in ("lossless", "reference"):
        raise ValueError("mode is 'lossless' or 'reference'")
    size = F.col("_metadata.file_size")
    small = (
        spark.read.text(_paths(paths), wholetext=True)
        .where(size <= whole_file_bytes)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            join_lines(F.col("value"), line_join).alias("text"),
        )
    )
    if mode == "reference":
        found = scan.records(
            scan.lines_of(spark, _paths(paths), whole_file_bytes, _tidy_line(line_join)), line_join
        ).where(F.col("text").rlike(MATCH))
        matches = _matches(small).unionByName(found.select("chat_id", (F.col("nth") - 1).alias("seq"), F.col("text").alias("m")))
        return _finish(_matched(matches), **options)
    big = _large_file_records(spark, paths, line_join, whole_file_bytes)
    records = _records(small).unionByName(big)
    return _lossless(records, **options)


def parse_export(exports: DataFrame, mode: str = "lossless", **options) -> DataFrame:
    """Cut ``(chat_id, text)`` rows into the message table.

    ``lossless`` starts a message at every time stamp and keeps brackets in bodies; a stamp without
    a sender becomes a ``System`` row with a null user. ``reference`` applies the one-pass pattern,
    which ends a body at any bracket. Options: ``strict`` raises on an impossible date instead of
    returning a null time with ``_bad_time`` set; ``keep_raw`` adds the body as written.
    """
    if mode == "lossless":
        return _lossless(_records(exports), **options)
    if mode != "reference":
        raise ValueError("mode is 'lossless' or 'reference'")
    return _finish(_matched(_matches(exports)), **options)


def _matches(exports: DataFrame) -> DataFrame:
    """``(chat_id, seq, m)``: the reference pattern's matches in whole texts."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(MATCH), 0)).alias("seq", "m")
    return exports.select("chat_id", found).withColumn("seq", F.col("seq").cast("long"))


def _matched(matches: DataFrame) -> DataFrame:
    """The parts of the first match in each text."""
    names = ["day", "clock", "half", "user", "body"]
    parts = [F.regexp_extract("m", MATCH, i).alias(n) for i, n in enumerate(names, 1)]
    return matches.select("chat_id", "seq", *parts, F.lit(False).alias("system"))


def _tidy_line(line_join: str) -> Column:
    """A line of a file as it stands in ``join_lines`` of the whole text."""
    blank = rf"[{SPACE}&&[^\r\n]]"
    line = F.regexp_replace("value", r"\r\z", "")
    line = F.regexp_replace(line, rf"{blank}*\r{blank}*", line_join)
    return F.translate(F.regexp_replace(line, rf"\A{blank}+|{blank}+\z", ""), LEFT_TO_RIGHT_MARK, "")


def export_time(day: Column, clock: Column, half: Column) -> Column:
    """Local time of a stamp; null where the date or the 12-hour clock does not exist."""
    d = F.transform(F.split(day, "/"), lambda x: x.cast("int"))
    c = F.transform(F.split(clock, ":"), lambda x: x.cast("int"))
    year = d[2] + F.when(d[2] < CENTURY_PIVOT, 2000).otherwise(1900)
    hour = c[0] % 12 + F.when(half == "PM", 12).otherwise(0)
    valid = c[0].between(1, 12) & (c[1] < 60) & (c[2] < 60)
    return F.when(
        valid, F.try_make_timestamp_ntz(year, d[1], d[0], hour, c[1], c[2].cast("decimal(8,6)"))
    )


def classify(body: Column) -> Column:
    """``struct<message_type, message>`` of a normalised text; the first marker that occurs decides.

    The text is bound once, so its own expression is not repeated for every marker.
    """

    def decide(b: Column) -> Column:
        kind, content = F.when(F.lit(False), ""), F.when(F.lit(False), "")
        for marker, name in MEDIA_MARKERS:
            hit = b.contains(marker)
            kind, content = kind.when(hit, name), content.when(hit, "")
        for missed, call, name in CALL_MARKERS:
            duration = F.regexp_extract(b, r"(\d+:\d+)", 1)
            after_comma = F.element_at(F.split(b, ","), -1)
            kind = kind.when(b.contains(missed), name).when(b.contains(call), name)
            content = content.when(b.contains(missed), "Missed").when(
                b.contains(call), F.when(duration != "", duration).otherwise(after_comma)
            )
        return F.struct(
            kind.otherwise("Text").alias("message_type"), content.otherwise(b).alias("message")
        )

    return let(body, decide)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _records(exports: DataFrame) -> DataFrame:
    """One row per stretch that starts with a time stamp; text before the first one is dropped."""
    return exports.select("chat_id", F.posexplode(_stamped("text")).alias("seq", "record"))


def _stamped(text: str) -> Column:
    return F.filter(F.split(text, f"(?={STAMP})"), lambda r: r.rlike(f"^{STAMP}"))


def _large_file_records(
    spark: SparkSession, paths: str | Sequence[str], line_join: str, whole_file_bytes: int
) -> DataFrame:
    """Records of files that are too large for one row.

    The text source splits the file over tasks and cuts it into lines. A line with a time stamp
    starts a group at the stamp; what stands before it, and lines without one, continue the group
    before. Which group that is, and how many messages stand before it, follows from running
    counts inside each file split (bounded by the split size) plus the counts of the splits before,
    so no task ever sees a whole file. Text before the first stamp is dropped before grouping.
    """
    line = F.translate(F.col("value"), LEFT_TO_RIGHT_MARK, "")
    lines = (
        spark.read.option("lineSep", "\n")
        .text(_paths(paths))
        .where(F.col("_metadata.file_size") > whole_file_bytes)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            line.alias("value"),
        )
        .withColumn("stamps", F.regexp_count("value", F.lit(STAMP)).cast("long"))
        .withColumn("starts", (F.col("stamps") > 0).cast("long"))
    )
    earlier = W.partitionBy("chat_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    numbered = lines.withColumns(
        {
            "nth": F.coalesce(F.sum("starts").over(earlier), F.lit(0)),
            "base": F.coalesce(F.sum("stamps").over(earlier), F.lit(0)),
        }
    )
    blocks = lines.groupBy("chat_id", "block").agg(
        F.sum("starts").alias("n"), F.sum("stamps").alias("m")
    )
    before = W.partitionBy("chat_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = blocks.select(
        "chat_id",
        "block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "m")],
    )
    at = F.regexp_instr("value", F.lit(STAMP))
    nth, base = F.col("n_before") + F.col("nth"), F.col("m_before") + F.col("base")
    part = lambda group, side, value, first: F.struct(
        group.alias("nth"), F.lit(side).alias("side"), value.alias("value"), first.alias("base")
    )
    none = F.lit(None).cast("long")
    head = F.substring(F.col("value"), F.lit(1), at - 1)
    tail = F.substring(F.col("value"), at, F.length("value"))
    cut = F.when(
        F.col("starts") == 1,
        F.array(part(nth, 0, head, none), part(nth + 1, 1, tail, base)),
    ).otherwise(F.array(part(nth, 0, F.col("value"), none)))
    empty_head = (F.col("starts") == 1) & (F.col("p.side") == 0) & (strip(F.col("p.value")) == "")
    pieces = (
        numbered.join(totals, ["chat_id", "block"])
        .select("chat_id", "block", "pos", "starts", F.explode(cut).alias("p"))
        .where((F.col("p.nth") > 0) & ~empty_head)
        .select("chat_id", "block", "pos", "p.*")
    )
    whole = (
        pieces.groupBy("chat_id", "nth")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "pos", "side", "value"))).alias("parts"),
            F.max("base").alias("base"),
        )
        .select(
            "chat_id",
            "base",
            join_lines(
                F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), line_join
            ).alias("text"),
        )
    )
    records = whole.select("chat_id", "base", F.posexplode(_stamped("text")).alias("sub", "record"))
    return records.select("chat_id", (F.col("base") + F.col("sub")).alias("seq"), "record")


def _lossless(records: DataFrame, **options) -> DataFrame:
    part = lambda i: F.regexp_extract("record", f"(?s)^{STAMP}(.*)$", i)
    rest = F.col("rest")
    sender = r"(?s)^ ?([^:]*?) ?: ?(.*)$"
    has_sender = rest.rlike(sender)
    split_up = records.select(
        "chat_id",
        "seq",
        part(1).alias("day"),
        part(2).alias("clock"),
        part(3).alias("half"),
        part(4).alias("rest"),
    ).select(
        "chat_id",
        "seq",
        "day",
        "clock",
        "half",
        F.when(has_sender, F.regexp_extract(rest, sender, 1)).alias("user"),
        F.when(has_sender, F.regexp_extract(rest, sender, 2)).otherwise(rest).alias("body"),
        (~has_sender).alias("system"),
    )
    return _finish(split_up, **options)


def _finish(parsed: DataFrame, strict: bool = False, keep_raw: bool = False) -> DataFrame:
    """Time, body and type of cut-out messages, in contract order plus ``_bad_time``."""
    stamp = export_time(F.col("day"), F.col("clock"), F.col("half"))
    if strict:
        why = F.concat_ws(" ", F.lit("impossible time stamp:"), "day", "clock", "half")
        stamp = F.coalesce(stamp, F.raise_error(why).cast("timestamp_ntz"))
    typed = parsed.withColumns(
        {"_normal": normalize_body(F.col("body")), "_time": stamp}
    ).withColumn("_typed", classify(F.col("_normal")))
    out = typed.select(
        "chat_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("_time").alias("date_time"),
        "user",
        F.when(F.col("system"), "System").otherwise(F.col("_typed.message_type")).alias("message_type"),
        F.when(F.col("system"), F.col("_normal")).otherwise(F.col("_typed.message")).alias("message"),
        *([F.col("body").alias("message_raw")] if keep_raw else []),
    )
    assert out.columns[: len(MESSAGE_SCHEMA)] == MESSAGE_SCHEMA.fieldNames()
    return out.withColumn("_bad_time", F.col("date_time").isNull())
