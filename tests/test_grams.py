"""N-grams counted and found by codes, and the joins of large vocabularies."""

import random
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from convolens.functions import text
from convolens.operators import embed, grams, index
from convolens.runtime import join_small

WORDS = [f"w{i}" for i in range(30)] + ["über", "zz", "straße"]


@pytest.fixture
def talk(chat):
    rng = random.Random(4)
    weight = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [("c", i, i, "u", " ".join(rng.choices(WORDS, weight, k=rng.randrange(0, 14)))) for i in range(150)]
    return chat(rows + [("c", 900, 1, "u", None), ("d", 1, 1, "u", "  "), ("c", 3, 3, "u", "w0 w0 w0 w0 w1")])


def counted(messages, low, high):
    """``term: (df, total)`` by plain Python."""
    df, total = Counter(), Counter()
    for r in messages.where("message IS NOT NULL").collect():
        words = r.message.split()
        found = Counter(" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))
        total += found
        df.update(found.keys())
    return {t: (df[t], total[t]) for t in total}


@pytest.mark.parametrize(
    "low, high, min_df, max_df, most", [(1, 1, 1, 1.0, None), (1, 3, 2, 0.3, 40), (1, 3, 1, 0.9, 200), (2, 3, 2, 0.9, 20)]
)
def test_vocabulary_is_that_of_all_terms(talk, low, high, min_df, max_df, most, monkeypatch):
    monkeypatch.setattr(grams, "STEP_TOKENS", 50)
    n = talk.where("message IS NOT NULL").count()
    kept = {t: x for t, x in counted(talk, low, high).items() if x[0] >= min_df and x[0] <= max_df * n}
    best = sorted(kept, key=lambda t: (-kept[t][1], t.encode()))[:most]
    got = index.tfidf_vocabulary(talk, (low, high), min_df, max_df, most).collect()
    assert {r.term: (r.df, r.total) for r in got} == {t: kept[t] for t in best} and len(got) == len(best)


def test_more_known_terms_than_fit_are_counted_as_strings(talk, monkeypatch):
    want = sorted(map(tuple, index.tfidf_vocabulary(talk, max_features=None).collect()))
    monkeypatch.setattr(index, "fits", lambda df: False)
    assert sorted(map(tuple, index.tfidf_vocabulary(talk, max_features=None).collect())) == want


@pytest.mark.parametrize("low, high", [(1, 3), (2, 2)])
def test_weights_equal_those_joined(talk, low, high, monkeypatch):
    monkeypatch.setattr(grams, "STEP_TOKENS", 50)
    terms = index.tfidf_vocabulary(talk, (low, high), 2, 0.9, 60)
    tokens = index.token_lists(index.indexable(talk.dropDuplicates(["chat_id", "seq"])))
    near = lambda df: sorted((r.chat_id, r.seq, r.keys, r.tfs, [round(w, 9) for w in r.weights]) for r in df.collect())
    coded = near(index.weight_lists(tokens, terms, (low, high), 60))
    monkeypatch.setattr(index, "fits", lambda df: False)
    assert coded and coded == near(index.weight_lists(tokens, terms, (low, high), None))


def test_rare_terms_are_not_shuffled(spark, chat, monkeypatch):
    often = [("c", i, i, "u", "the same words again") for i in range(20)]
    once = [("d", i, i, "u", " ".join(f"x{i}y{j}" for j in range(10))) for i in range(50)]
    seen = []
    real = index._gram_sums
    monkeypatch.setattr(index, "_gram_sums", lambda *a: seen.append(real(*a)) or seen[-1])
    terms = {r.term for r in index.tfidf_vocabulary(chat(often + once)).collect()}
    assert "the same words" in terms and [df.count() for df in seen] == [3, 2]


def test_salted_copies_are_not_broadcast(spark, tmp_path):
    """Files of a few MB look small to Spark, 32 copies of their rows are not."""
    spark.range(1000).select(F.col("id").alias("k"), F.lit(1.0).alias("w")).write.parquet(str(tmp_path / "small"))
    small, big = spark.read.parquet(str(tmp_path / "small")), spark.range(5000).select("id", (F.col("id") % 1000).alias("k"))
    joined = join_small(big, small, ["k"], ["id"], max_rows=0)
    assert joined.count() == 5000
    assert "Broadcast" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)


ODD = ["", None, "a bb", "é éa 漢 漢字 a", "x_1 22 3", "bb", ":information: heart-eyes", "  ", "\U00010400 \U00010400b", "ab", "cd", "வணக்கம்"]


@pytest.mark.parametrize("most, marks", [(1, False), (7, True), (1_000_000, False)])
def test_tokens_of_a_text_are_those_of_the_pattern(spark, chat, monkeypatch, most, marks):
    """Texts cut in bytes, across steps and rows, give what the JVM's pattern gives."""
    monkeypatch.setattr(grams, "STEP_TOKENS", most)
    texts = index.indexable(chat([("c", i, i, "u", t) for i, t in enumerate(ODD)]), marks)
    want = texts.select(text.tokens(F.col("clean_text")).alias("t")).collect()
    lists = index.token_lists(texts).select("tokens").toArrow().to_batches()
    got = []
    for batch in grams.steps(iter(lists), "tokens"):
        flat, row = grams.split(batch.column("tokens"))
        got += [[w for w, r in zip(flat.to_pylist(), row) if r == i] for i in range(batch.num_rows)]
    assert got == [r.t for r in want] and sum(map(len, got)) > 8


def test_sums_are_not_combined_twice_before_the_shuffle(spark, talk):
    """A task's memory must not hold all its n-grams; partitions go with the input."""
    tokens = index.token_lists(index.indexable(talk))
    plan = plan_of(index._word_sums(tokens, 5))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]


def test_rows_by_key_need_no_shuffle(spark, talk, monkeypatch):
    monkeypatch.setattr(grams, "STEP_TOKENS", 40)
    lists = index.word_lists(index.indexable(talk))
    rows = index.rows_by_key(lists, word="keys")
    plan = plan_of(rows)
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, index.postings_in(lists).collect()))


def test_own_weights_clean_texts_once(talk):
    rows = lambda df: sorted((r.term, r.chat_id, r.seq, r.tf, round(r.weight, 9)) for r in df.collect())
    own = index.own_weights(talk)
    assert rows(own) == rows(index.tfidf_weights(talk, index.tfidf_vocabulary(talk))) and "regexp_replace" not in plan_of(own)


@pytest.mark.parametrize("dim", [5, 64])
def test_vectors_hash_each_word_of_a_step_once(talk, dim, monkeypatch):
    monkeypatch.setattr(grams, "STEP_TOKENS", 90)
    monkeypatch.setattr(embed, "HASH_ROWS", 4)
    texts = index.indexable(talk)
    rows = lambda df: sorted(str(r) for r in df.select("chat_id", "seq", "vector").collect())
    assert rows(embed.hashed(index.token_lists(texts), dim)) == rows(embed.embed(texts, "clean_text", dim=dim))
