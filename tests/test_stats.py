import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from convolens.operators import retrieval, stats
from convolens.operators.gaps import next_message
from convolens.plans import report as rp


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_response_time_goes_to_the_earlier_author(spark, chat):
    df = chat([
        ("c", 0, 0, "a", "x"), ("c", 1, 10, "b", "x"), ("c", 2, 30, "b", "x"),
        ("c", 3, 35, "a", "x"), ("c", 4, 40, "d", " \u00a0"), ("c", 5, 95, "e", "x"),
    ])
    assert as_dict(stats.response_time(df), "user", "avg_response_sec") == {
        "a": 35.0, "b": 5.0, "e": 0.0,
    }
    assert as_dict(stats.longest_silence(df), "user", "longest_silence_sec") == {
        "a": 60.0, "b": 5.0, "e": 0.0,
    }


@pytest.mark.parametrize("by", [(), ("chat_id",)])
def test_ranged_gaps_equal_a_plain_window(spark, chat, by):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        # One chat and one moment hold a large share of all rows.
        c = "hot" if rng.random() < 0.5 else f"c{rng.randrange(20)}"
        t = 500 if rng.random() < 0.3 else rng.randrange(1000)
        rows.append((c, i, t, f"u{rng.randrange(4)}", "x"))
    df = chat(rows)
    out = ["chat_id", "seq", "next_user", "next_time", "gap_sec"]
    got = sorted(tuple(r) for r in next_message(df, by, max_group_rows=0).select(out).collect())
    rows.sort(key=lambda r: ((r[0],) if by else ()) + (r[2], r[0], r[1]))
    want = []
    for a, b in zip(rows, [*rows[1:], None]):
        if b is not None and by and b[0] != a[0]:
            b = None
        want.append((a[0], a[1], b and b[3], b and float(b[2] - a[2])))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == sorted(want, key=lambda r: r[:2])
    plain = next_message(df, ("chat_id",)).select(out)
    if by:
        assert sorted(tuple(r) for r in plain.collect()) == got


def test_no_full_table_window_in_one_partition(spark, chat):
    df = chat([("c", i, i, "u", "x") for i in range(100)])
    plan = plan_of(next_message(df, ("chat_id",)))
    assert "SinglePartition" not in plan


def test_dominance_sums_to_one(spark, chat):
    df = chat([(f"c{i % 3}", i, i, f"u{i % 7}", "x") for i in range(100)])
    total = stats.dominance(df).agg(F.sum("share")).first()[0]
    assert abs(total - 1) < 1e-9
    per_chat = stats.dominance(df, ("chat_id",)).groupBy("chat_id").agg(F.sum("share")).collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in per_chat)


def test_null_and_blank_messages(spark, chat):
    df = chat([("c", 0, 0, "a", None), ("c", 1, 1, "a", ""), ("c", 2, 2, None, "x"), ("c", 3, 3, "b", "x")])
    assert as_dict(stats.user_activity(df), "user", "total_messages") == {"b": 1}
    row = stats.dataset_stats(df).first()
    assert (row.total_messages, row.unique_users) == (3, 2)


def test_wake_sleep(spark, chat):
    h = 3600
    df = chat([("c", i, t * h, "a", "x") for i, t in enumerate([7, 12, 23, 24 + 9, 24 + 20])])
    row = stats.wake_sleep(df).first()
    assert (row.avg_first_hour, row.avg_last_hour) == (8.0, 21.5)


def test_top_words_ties_and_stop_words(spark, chat):
    df = chat([("c", 0, 0, "a", "the zz yy yy b"), ("c", 1, 1, "a", "xx zz")])
    assert [tuple(r) for r in stats.top_words(df, n=2).orderBy("word").collect()] == [("yy", 2), ("zz", 2)]
    assert stats.top_words(df, stop_words=[]).count() == 4
    assert "the" not in {r.word for r in stats.top_words(df).collect()}
    many = chat([("c", 0, 0, "a", " ".join(f"word{i}" for i in range(700)))])
    assert stats.top_words(many, n=500).count() == 500


def test_sentiment_rules(spark, chat):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "token string, valence double")
    df = chat([
        ("c", 0, 0, "a", "good"), ("c", 1, 1, "b", "not good"), ("c", 2, 2, "d", "very good"),
        ("c", 3, 3, "e", "meh"), ("c", 4, 4, "f", "don't be bad"),
    ])
    s = lambda v: v / (v * v + 15) ** 0.5
    plain = as_dict(stats.sentiment_by_user(df, lex), "user", "avg_sentiment")
    assert plain["a"] == plain["b"] == pytest.approx(s(2)) and plain["e"] == 0
    ruled = as_dict(stats.sentiment_by_user(df, lex, rules=True), "user", "avg_sentiment")
    assert ruled["b"] == pytest.approx(s(2 * -0.74))
    assert ruled["d"] == pytest.approx(s(2.293))
    assert ruled["f"] == pytest.approx(s(-2 * -0.74))


def by_hand(message, lex, rules, emphasis):
    """Sentiment of one message, word by word."""
    import re

    from convolens.operators import sentiment as m

    words = [w.replace("'", "") for w in re.findall(r"[\w']+", message)]
    caps = [w.isupper() for w in words]
    mixed = emphasis and 0 < sum(caps) < len(caps)
    words = [w.lower() for w in words]
    total = 0.0
    for i, w in enumerate(words):
        v = sign = lex.get(w, 0.0)
        sign = (sign > 0) - (sign < 0)
        v += sign * 0.733 * (mixed and caps[i])
        if rules:
            for d, share in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i >= d and words[i - d] in m.BOOSTERS + m.DAMPENERS:
                    step = 0.293 if words[i - d] in m.BOOSTERS else -0.293
                    v += sign * share * (step + 0.733 * (mixed and caps[i - d]))
            if any(i >= d and words[i - d] in m.NEGATIONS for d in (1, 2, 3)):
                v *= -0.74
        if emphasis and "but" in words:
            v *= 0.5 if i < words.index("but") else 1.5 if i > words.index("but") else 1
        total += v
    if emphasis:
        q = message.count("?")
        add = min(message.count("!"), 4) * 0.292 + (0.96 if q > 3 else q * 0.18 if q > 1 else 0)
        total += ((total > 0) - (total < 0)) * add
    return total / (total * total + 15) ** 0.5


@pytest.mark.parametrize("rules", [False, True])
@pytest.mark.parametrize("emphasis", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_sentiment_equals_a_plain_computation(spark, chat, monkeypatch, rules, emphasis, small):
    from convolens.operators import sentiment

    lex = {"good": 2.0, "bad": -2.5, "fine": 0.5, "but": 0.25}
    table = spark.createDataFrame([*lex.items(), ("good", 1.0), (None, 9.0)], "token string, valence double")
    rng = random.Random(4)
    pool = "good GOOD bad BAD fine but BUT not never very VERY hardly HARDLY day it's Don't ok !!! ? ??".split()
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(300)] + ["!", "GOOD", "?????", "good?????!!!!!!"]
    if not small:
        monkeypatch.setattr(sentiment, "fits", lambda df: False)
    df = chat([("c", i, i, "u", t) for i, t in enumerate(texts)] + [("c", 9000, 1, "u", None), ("c", 9001, 1, "u", " ")])
    got = as_dict(sentiment.message_sentiment(df, table, (), rules, emphasis), "seq", "sentiment")
    assert got == pytest.approx({i: by_hand(t, lex, rules, emphasis) for i, t in enumerate(texts)})


def test_sentiment_needs_no_shuffle_below_the_mean(spark, chat):
    lex = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    df = chat([("c", i, i, f"u{i % 3}", "so good") for i in range(20)])
    plan = plan_of(stats.sentiment_by_user(df, lex, ("chat_id",), rules=True, emphasis=True))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_user_and_recent_messages(spark, chat):
    import datetime as dt

    df = chat([("c", i, i * 3600, u, "x") for i, u in enumerate(["Al.x", "alx", "Bo", "AL"])])
    assert [r.seq for r in retrieval.user_messages(df, "^al", limit=2).collect()] == [3, 1]
    assert [r.seq for r in retrieval.user_messages(df, "l.x", literal=True).collect()] == [0]
    recent = retrieval.recent_messages(df, hours=2, as_of=dt.datetime(2024, 1, 1, 4))
    assert [r.seq for r in recent.collect()] == [3, 2]


def test_report_long_has_every_metric(spark, chat):
    lex = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    df = chat([("c", 0, 0, "a", "good \U0001f602"), ("d", 1, 9, "b", "fine")])
    for by in ((), ("chat_id",)):
        long = rp.report_long(rp.report(df, lex, by), by)
        assert {r.metric for r in long.select("metric").distinct().collect()} == set(rp.LONG_FORM)
