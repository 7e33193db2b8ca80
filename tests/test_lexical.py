"""Sparse requests against sparse messages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from convolens.operators import index, lexical, search
from convolens.operators.best import Best
from convolens.sources import index_store

WORDS = [f"w{i:03d}" for i in range(300)]


def brute(messages, requests, k, floor=0.0):
    """``messages``: id -> {key: weight}; ``requests``: name -> {key: weight}."""
    at = {w: i for i, w in enumerate(WORDS)}
    ids, names = sorted(messages), sorted(requests)
    m, q = np.zeros((len(ids), len(WORDS))), np.zeros((len(names), len(WORDS)))
    for i, key in enumerate(ids):
        for w, x in messages[key].items():
            m[i, at[w]] = x
    for j, name in enumerate(names):
        for w, x in requests[name].items():
            q[j, at[w]] = x
    scores = np.round(m @ q.T, 9)
    out = []
    for j, name in enumerate(names):
        found = sorted((-scores[i, j], *ids[i]) for i in np.flatnonzero(scores[:, j] > floor))
        out += [(name, c, s, -x) for x, c, s in found[:k]]
    return out


def tables(spark, n_messages, n_requests, size, ones=False, seed=3):
    rng = random.Random(seed)
    weight = lambda: 1.0 if ones else rng.randrange(1, 9) / 8
    messages = {(f"c{i % 3}", i): {w: weight() for w in rng.sample(WORDS, rng.randrange(0, 20))} for i in range(n_messages)}
    requests = {f"q{i:04d}": {w: rng.randrange(1, 9) / 8 for w in rng.sample(WORDS, size)} for i in range(n_requests)}
    lists = [(c, s, list(x), list(x.values())) for (c, s), x in messages.items()] + [("c9", 1, None, None)]
    schema = "chat_id string, seq long, keys array<string>, weights array<double>"
    m = spark.createDataFrame(lists, schema).repartition(5)
    flat = pa.table({
        "query_id": [n for n, x in requests.items() for _ in x],
        "key": [w for x in requests.values() for w in x],
        "weight": [v for x in requests.values() for v in x.values()],
    })
    return messages, requests, m.drop("weights") if ones else m, spark.createDataFrame(flat)


def ranked(hits, k):
    rows = search.top_k(hits, search._best_first(["chat_id", "seq"]), k, ["query_id"])
    return sorted(map(tuple, rows.collect()))


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])


@pytest.mark.parametrize("ones", [True, False])
@pytest.mark.parametrize("weights, keys, products", [(200_000, 2_000_000, 4_000_000), (60, 40, 50)])
def test_products_equal_brute_force(spark, monkeypatch, ones, weights, keys, products):
    for name, value in (("BLOCK_WEIGHTS", weights), ("BLOCK_KEYS", keys), ("PRODUCTS", products)):
        monkeypatch.setattr(lexical, name, value)
    messages, requests, m, q = tables(spark, 150, 12, 25, ones)
    hits = lexical.best_messages(m, q, 4, 0.3)
    plan = plan_of(hits)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan
    same(ranked(hits, 4), brute(messages, requests, 4, 0.3))


def test_more_weights_than_one_block(spark):
    messages, requests, m, q = tables(spark, 400, 3000, 70)
    assert q.count() > lexical.BLOCK_WEIGHTS
    hits = lexical.best_messages(m, q, 3)
    same(ranked(hits, 3), brute(messages, requests, 3))


def test_only_k_rows_a_task_and_request_leave_the_tasks(spark):
    _, requests, m, q = tables(spark, 400, 20, 70)
    assert lexical.best_messages(m.coalesce(4), q, 3).count() <= 3 * 4 * len(requests)


def test_no_requests_and_no_messages(spark):
    _, _, m, q = tables(spark, 10, 2, 3)
    assert lexical.best_messages(m, q.limit(0), 3).count() == 0
    assert lexical.best_messages(m.limit(0), q, 3).count() == 0


def test_ties_go_to_smaller_ids():
    best = Best(["q"], 2, 0.0, ["chat_id", "seq"])
    ids = pa.table({"chat_id": ["b", "a", "a", "c"], "seq": [1, 2, 1, 0]})
    best.take_pairs(ids, np.arange(4), np.zeros(4, int), np.array([1.0, 1.0, 1.0, 0.5]))
    [batch] = best.batches()
    assert [(r["chat_id"], r["seq"]) for r in batch.to_pylist()] == [("a", 1), ("a", 2)]


@pytest.fixture
def talk(chat):
    rng = random.Random(8)
    return chat([(f"c{i % 4}", i, i, f"u{i % 3}", " ".join(rng.choices(WORDS[:80], k=rng.randrange(1, 12)))) for i in range(200)])


@pytest.mark.parametrize("few", [0, 1000])
def test_lists_and_rows_give_the_same_hits(spark, talk, monkeypatch, few):
    t = index_store.in_memory(talk)
    rng = random.Random(1)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(WORDS[:80], k=6))) for i in range(9)], "query_id string, text string")
    want = [sorted(map(tuple, df.collect())) for df in (
        search.keyword_search(t.postings, t.vocabulary, queries, 4), search.tfidf_search(t.weights, t.terms, queries, 4))]
    monkeypatch.setattr(search, "FILTER_VALUES", few)
    got = [sorted(map(tuple, df.collect())) for df in (
        search.keyword_search(t.postings, t.vocabulary, queries, 4, t.words),
        search.tfidf_search(t.weights, t.terms, queries, 4, lists=t.lists))]
    for a, b in zip(got, want):
        same(a, b)


def test_weights_need_no_shuffle_after_the_vocabulary(spark, talk):
    terms = index.tfidf_vocabulary(talk)
    plan = plan_of(index.tfidf_weights(talk, terms))
    assert "Exchange" not in plan and "Join" not in plan


def test_a_vocabulary_too_large_to_send_is_joined(spark, talk, monkeypatch):
    terms = index.tfidf_vocabulary(talk, max_features=None, min_df=1)
    rows = lambda df: {(r.chat_id, r.seq, r.term): (r.tf, round(r.weight, 9)) for r in df.collect()}
    one = rows(index.tfidf_weights(talk, terms, max_features=None))
    monkeypatch.setattr(index, "fits", lambda df: False)
    assert rows(index.tfidf_weights(talk, terms, max_features=None)) == one and len(one) > 500


def test_lists_of_one_id_count_as_one_message(spark, chat, monkeypatch):
    rng = random.Random(5)
    rows = [("c", i // 2 if i < 20 else i, i, "u", " ".join(rng.choices(WORDS[:40], k=8))) for i in range(90)]
    t = index_store.in_memory(chat(rows + [(None, 3, 3, "u", "w001 w002"), (None, 3, 4, "u", "w001 w003")]))
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(WORDS[:40], k=6))) for i in range(7)], "query_id string, text string")
    monkeypatch.setattr(search, "FILTER_VALUES", 0)
    run = lambda df: sorted(map(str, df.collect()))
    assert run(search.tfidf_search(t.weights, t.terms, queries, 200, lists=t.lists, merge=True)) == run(search.tfidf_search(t.weights, t.terms, queries, 200))
    words = search.keyword_search(t.postings, t.vocabulary, queries, 200, t.words, merge=True)
    assert run(words) == run(search.keyword_search(t.postings, t.vocabulary, queries, 200))


def test_blocks_of_a_grid_are_larger_than_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_WEIGHTS", 10)
    monkeypatch.setattr(lexical, "BLOCK_KEYS", 300)
    messages, requests, m, q = tables(spark, 150, 12, 25)
    hits = lexical.best_messages(m, q, 4)
    assert "hashpartitioning(_q" in plan_of(hits) and 12 * 25 / (lexical.GRID * 10) > 3
    same(ranked(hits, 4), brute(messages, requests, 4))
