"""Message tables derived from the test tables, as used by the registered queries and the bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions.text import EMOJI_RANGES
from convolens.runtime import spread
from convolens.schema import as_messages

START = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"

# Suffixes that give plain messages links, emojis, another script and capitals.
SUFFIXES = [
    " see https://example.org/a?b=1 or WWW.example.org",
    " \U0001f602\U0001f602",
    " \U0001f44d\U0001f3fd",
    " ℹ",
    " வணக்கம்",
    " HELLO There",
    "",
    "",
]
# Bodies the export uses for media and calls, sent after the text; None sends nothing more.
MARKERS = [
    ("\u200eimage omitted", "Image", ""),
    ("\u200eVideo omitted", "Video", ""),
    ("\u200esticker omitted", "Sticker", ""),
    ("\u200eaudio omitted", "Audio", ""),
    ("report.pdf \u200edocument omitted", "Document", ""),
    ("\u200eContact omitted", "Contact", ""),
    ("Location shared", "Location", ""),
    ("\u200eMissed voice call, Tap to call back", "Voice Call", "Missed"),
    ("\u200eVoice call, \u200e12:34", "Voice Call", "12:34"),
    ("\u200eVoice call, no answer", "Voice Call", " no answer"),
    ("\u200eMissed video call, tap to call back", "Video Call", "Missed"),
    ("\u200eVideo call, 1:02 min", "Video Call", "1:02"),
    ("\u200eVideo call, declined", "Video Call", " declined"),
    (None, "Text", None),
    (None, "Text", None),
    (None, "Text", None),
]
# Frequent words of the four fixture languages, as a caller's own stop list.
STOP_WORDS = (
    "the of and to in is it on for as with was that by this are be or from at an "
    "le la les un une de des du et en que qui il au "
    "der die das und ein eine zu den von mit ist im es auf "
    "el los las una por con para se"
).split()
# Tables whose rows carry enough text to be worth spreading.
TEXT_TABLES = {"conversations", "documents"}
LEXICON = [
    ("the", 1.5), ("la", -1.2), ("die", 0.8), ("que", -2.1), ("and", 2.4), ("der", -0.6),
    ("of", 0.4), ("les", -1.7), ("und", 1.1), ("in", -0.3), ("de", 3.0), ("is", -2.8),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def choose(index: Column, options: list) -> Column:
    """``options[index]`` as a chain of conditions."""
    out = F.lit(options[-1])
    for i in reversed(range(len(options) - 1)):
        out = F.when(index == i, F.lit(options[i])).otherwise(out)
    return out


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a message table; times are not monotone in ``seq`` and have ties."""
    seconds = F.expr("conv_id * 2220 + turn * (47 + (conv_id * (turn + 1)) % 13)")
    df = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("chat_id"),
        F.col("turn").alias("seq"),
        _after_start(seconds).alias("date_time"),
        F.col("role").alias("user"),
        F.lit("Text").alias("message_type"),
        F.col("text").alias("message"),
    )
    return as_messages(df)


def _after_start(seconds: Column) -> Column:
    return F.expr(f"timestamp_ntz'{START}'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def rich_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` with links, emojis, marks and capitals added."""
    which = F.pmod(F.col("chat_id").cast("long") + F.col("seq"), F.lit(8))
    return messages(spark, sf_dir).withColumn(
        "message", F.concat("message", choose(which, SUFFIXES))
    )


# Every emoji in turn, three after each message.
EMOJI_SHIFTS = (0, 491, 977)


def emoji_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` with three emojis after each, so that all of them occur."""
    table_of = F.split(F.lit(" ".join(emoji_points())), " ")
    n = len(emoji_points())
    start = F.col("chat_id").cast("long") * 7 + F.col("seq")
    picked = [F.get(table_of, F.pmod(start + s, F.lit(n)).cast("int")) for s in EMOJI_SHIFTS]
    return messages(spark, sf_dir).withColumn("message", F.concat("message", *picked))


def emoji_points() -> list[str]:
    """All code points of the emoji ranges, in order."""
    ends = [(span.split("-") * 2)[:2] for span in EMOJI_RANGES]
    return [chr(c) for a, b in ends for c in range(int(a, 16), int(b, 16) + 1)]


# Words before the text that turn or scale the valence of its first lexicon words.
MOODS = ["not ", "very ", "barely the ", "so never ", ""]


# What may stand before and after the text: capitals, a turn and marks.
EMPHASIS = [("THE day, but ", "!"), ("so VERY the ", "!!! really?"), ("Die and BUT not ", "??"), ("", " THE END?????"), ("", "")]


def emphatic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.pmod(F.col("chat_id").cast("long") + F.col("seq"), F.lit(len(EMPHASIS)))
    before, after = (choose(which, [e[i] for e in EMPHASIS]) for i in range(2))
    return messages(spark, sf_dir).withColumn("message", F.concat(before, "message", after))


def mood_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.pmod(F.col("chat_id").cast("long") + F.col("seq"), F.lit(len(MOODS)))
    return messages(spark, sf_dir).withColumn("message", F.concat(choose(which, MOODS), "message"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as long messages: one chat per source, one user per language."""
    df = table(spark, sf_dir, "documents").select(
        F.col("source").alias("chat_id"),
        F.col("doc_id").alias("seq"),
        _after_start(F.col("doc_id") * 61).alias("date_time"),
        F.col("lang").alias("user"),
        F.lit("Text").alias("message_type"),
        F.col("text").alias("message"),
    )
    return as_messages(df)


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as many short messages in ten chats."""
    df = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("chat_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("date_time"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("message_type"),
        F.col("event_type").alias("message"),
    )
    return as_messages(df)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("user")
    )


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, label, vector)``: mean vector of each label.

    Averages are taken per position, so a large label is summed where it lies.
    """
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    )
    whole = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select(
        F.col("label").alias("ord"),
        F.col("label").cast("string").alias("label"),
        F.transform("v", lambda p: p["x"]).alias("vector"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")


def marker_index() -> Column:
    return F.pmod(F.col("chat_id").cast("long") * 3 + F.col("seq"), F.lit(16))


def export_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``messages``, most of them followed by a media or call marker of the same time.

    Texts have even and markers odd ``seq``; ``user`` names the message.
    """
    marked = choose(marker_index(), [m[0] for m in MARKERS])
    both = F.filter(F.array("message", marked), lambda b: b.isNotNull())
    sent = messages(spark, sf_dir).select("*", F.posexplode(both).alias("nth", "body"))
    numbered = sent.withColumn("seq", F.col("seq") * 2 + F.col("nth"))
    return numbered.select(
        "chat_id",
        "seq",
        "date_time",
        F.concat_ws("-", "user", "chat_id", "seq").alias("user"),
        "body",
    )


def stamp(ts: Column) -> Column:
    """A time in export notation."""
    return F.concat(
        F.lit("["),
        F.concat_ws("/", F.day(ts), F.month(ts), F.lpad((F.year(ts) % 100).cast("string"), 2, "0")),
        F.lit(", "),
        ((F.hour(ts) + 11) % 12 + 1).cast("string"),
        *[F.concat(F.lit(":"), F.lpad(p.cast("string"), 2, "0")) for p in (F.minute(ts), F.second(ts).cast("int"))],
        F.lit("\u202f"),
        F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        F.lit("]"),
    )


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as the text a chat export shows, with ``(chat_id, seq)`` for ordering."""
    line = F.concat(stamp(F.col("date_time")), F.lit(" "), "user", F.lit(": "), "body")
    return export_bodies(spark, sf_dir).select("chat_id", "seq", line.alias("value"))


def exports(spark: SparkSession, sf_dir: str, sep: str = "\n") -> DataFrame:
    """``(chat_id, text)``: per message an export with that message, a notice and an answer."""
    head = stamp(F.col("date_time"))
    notice = F.lit(" Messages are encrypted")
    answer = F.concat(F.lit(" Bo: Got "), "chat_id", F.lit("/"), "seq", F.lit(" [ok] thanks"))
    line = F.concat(head, F.lit(" "), "user", F.lit(": "), "body")
    return export_bodies(spark, sf_dir).select(
        F.concat_ws("-", "chat_id", "seq").alias("chat_id"),
        F.concat_ws(sep, line, F.concat(head, notice), F.concat(head, answer)).alias("text"),
    )


CALL = '{"function_call": {"name": "%s", "arguments": {%s}}}'


def json_text(col: str | Column) -> Column:
    """A string as a JSON literal."""
    out = F.replace(F.col(col) if isinstance(col, str) else col, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def call_text(name: str, argument: str, value: Column) -> Column:
    before, after = (CALL % (name, f'"{argument}": \0')).split("\0")
    return F.concat(F.lit(before), value, F.lit(after))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a model response: prose, tagged, bare, embedded, broken or unknown calls."""
    quoted = json_text("text")
    shapes = [
        F.concat(F.lit("  "), F.col("text"), F.lit(" `ok` ")),
        F.concat(
            F.lit("<think>"), "text", F.lit("</think>\n"),
            call_text("semantic_search_optimized", "query", quoted),
        ),
        call_text("keyword_search_optimized", "keywords", quoted),
        F.concat(F.lit("``Sure: `"), call_text("tfidf_search_optimized", "query", quoted), F.lit("` done")),
        F.concat(F.lit('{"function_call": {"name": "get_stats", '), quoted),
        call_text("best_search", "query", quoted),
    ]
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(shapes)))
    response = shapes[-1]
    for i in reversed(range(len(shapes) - 1)):
        response = F.when(which == i, shapes[i]).otherwise(response)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))


# Function per benchmark item, in turn.
ROUTED = [
    ("tfidf_search_optimized", "query"),
    ("KEYWORD_search_optimized", "keywords"),
    ("semantic_search_optimized", "query"),
    ("combined_search_optimized", "query"),
    ("get_user_messages", "username"),
    ("get_recent_messages", "hours"),
    ("get_stats", "none"),
    ("best_search", "query"),
]


# Added to an item's number for its second request.
SECOND = 1_000_000


def request_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a tool call with the item's text as its argument.

    A text is no number of hours and names no user, so such items also ask with a value that fits,
    and every third item with a pattern that is none.
    """
    item = F.col("item_id")
    which = F.pmod(item, F.lit(len(ROUTED)))

    def response(value: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, (name, argument) in enumerate(ROUTED):
            out = F.when(which == i, call_text(name, argument, value)).otherwise(out)
        return out

    fitting = F.when(which == 4, F.lit('"ASSIST"')).when(which == 5, (item * 100).cast("string"))
    asked = [
        F.struct(item.alias("request_id"), response(json_text("text")).alias("response")),
        F.when(
            which.isin(4, 5),
            F.struct((item + SECOND).alias("request_id"), response(fitting).alias("response")),
        ),
        F.when(
            item % 3 == 0,
            F.struct(
                (item + 2 * SECOND).alias("request_id"),
                call_text("get_user_messages", "username", F.lit('"al("')).alias("response"),
            ),
        ),
    ]
    whole = F.filter(F.array(*asked), lambda r: r.isNotNull())
    return table(spark, sf_dir, "benchmark").select(F.inline(whole))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a search request."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text"
    )
