import pytest
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.functions.arrays import run_lengths


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "t string").select(column(F.col("t")))
    return df.first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("See HTTPS://x.org/a?b now", "see now"),
        ("axwww.b.c d", "ax d"),
        ("a--b_c  \u00e9\u00a0!", "a b_c \u00e9"),
        ("\U0001f602\u2139", ":information:"),
        ("a \u2139 b", "a :information: b"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_vowel_signs_need_the_option(spark):
    word = "\u0bb5\u0ba3\u0b95\u0bcd\u0b95\u0bae\u0bcd"
    assert " " in one(spark, word, text.clean_text)
    assert one(spark, word, lambda c: text.clean_text(c, keep_marks=True)) == word


def test_emojis_come_apart(spark):
    family = "a\U0001f44d\U0001f3fd 1#\u00e9 \U0001f468\u200d\U0001f469 \u2764\ufe0f"
    assert one(spark, family, text.emojis) == [
        "\U0001f44d", "\U0001f3fd", "\U0001f468", "\U0001f469", "\u2764",
    ]


def test_emoji_aliases(spark):
    assert one(spark, "a\n\U0001f602b", text.emoji_aliases) == "a\n:face_with_tears_of_joy:b"
    mine = lambda c: text.emoji_aliases(c, {"\U0001f602": ":x:"})
    assert one(spark, "\U0001f602\U0001f525", mine) == ":x::fire:"
    assert one(spark, "\U0001f9a9 \u203d \u2328", text.emoji_aliases) == ":flamingo: \u203d :keyboard:"
    assert one(spark, None, text.emoji_aliases) is None
    before = lambda c: text.clean_text(c, emoji="before")
    assert one(spark, "So \U0001f602!", before) == "so face_with_tears_of_joy"


def test_every_emoji_has_a_name():
    assert len(text.emoji_names()) > 1300
    assert all(n.startswith(":") and n.endswith(":") and " " not in n for n in text.emoji_names().values())


def test_counts_and_caps(spark):
    assert one(spark, " a\u00a0b\x1fc ", text.word_count) == 3
    assert one(spark, "\U0001f602x", text.char_count) == 2
    assert one(spark, "ABc\u00c9", text.caps_ratio) == 0.75
    assert one(spark, "", text.caps_ratio) == 0.0


@pytest.mark.parametrize(
    "raw, want",
    [
        ("", []),
        ("Aa", ["aa"]),
        ("aa b cc dd", ["aa", "cc", "dd", "aa cc", "cc dd", "aa cc dd"]),
        ("aa bb", ["aa", "bb", "aa bb"]),
    ],
)
def test_ngrams(spark, raw, want):
    assert one(spark, raw, lambda c: text.ngrams(text.tokens(c))) == want


def test_run_lengths(spark):
    got = one(spark, "b a b c a b", lambda c: run_lengths(F.split(c, " ")))
    assert [tuple(r) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "", lambda c: run_lengths(text.tokens(c))) is None


def test_a_callers_table_of_emoji_names(spark):
    rows = [
        ("\U0001f44d", ":+1:"), ("\U0001f44d\U0001f3fd", ":medium_thumb:"), ("\U0001f1e9\U0001f1ea", ":Germany:"),
        ("\u2764\ufe0f\u200d\U0001f525", ":heart_on_fire:"), ("\u2764\ufe0f", ":heart:"), (None, ":x:"), ("", ":y:"), ("z", None),
    ]
    names = spark.createDataFrame(rows, "emoji string, name string")
    aliases = text.alias_table(names)
    assert len(aliases) == 5
    given = {
        "ok \U0001f44d!": "ok :+1:!",
        "\U0001f44d\U0001f3fd\U0001f44d": ":medium_thumb::+1:",
        "to \U0001f1e9\U0001f1ea and \U0001f1e9": "to :Germany: and \U0001f1e9",
        "\u2764\ufe0f\u200d\U0001f525\u2764\ufe0f\u2764": ":heart_on_fire::heart::red_heart:",
        "\U0001f525 plain": ":fire: plain",
        "no emoji": "no emoji",
    }
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.n for r in df.withColumn("n", text.emoji_aliases(F.col("t"), aliases)).collect()} == given
    with pytest.raises(ValueError, match="at most"):
        text.alias_table(spark.range(text.ALIAS_ROWS + 1).select(F.col("id").cast("string").alias("emoji"), F.lit("n").alias("name")))
