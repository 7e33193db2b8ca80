import dataclasses
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from convolens.operators import embed, index, search
from convolens.runtime import join_small
from convolens.sources import index_store

WORDS = "ab abc abcd bca cab the then them other another thing things in inn dinner zz".split()


@pytest.fixture
def talk(chat):
    rng = random.Random(5)
    return chat([
        (f"c{i % 3}", i, i, f"u{i % 2}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 8))))
        for i in range(120)
    ])


def test_keyword_search_equals_brute_force(spark, talk):
    asked = {"q1": "abc in In", "q2": "Other x then", "q3": "nothinghere"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    postings = index.word_postings(talk)
    got = search.keyword_search(postings, index.word_freq(postings), queries, k=7).collect()
    rows = [(r.chat_id, r.seq, set(r.message.split())) for r in talk.collect()]
    vocab = {w for *_, ws in rows for w in ws if len(w) > 2}
    want = []
    for qid, text in asked.items():
        scores = Counter()
        for kw in text.lower().split():
            if len(kw) < 2:
                continue
            for w in vocab:
                if w == kw:
                    gain = 2.0
                elif kw in w or w in kw:
                    sim = len(set(kw) & set(w)) / len(set(kw) | set(w))
                    gain = 0.8 * sim if sim > 0.5 else 0
                else:
                    gain = 0
                for c, s, ws in rows:
                    if gain and w in ws:
                        scores[c, s] += gain
        best = sorted(((-round(v, 9), c, s) for (c, s), v in scores.items()))[:7]
        want += [(qid, c, s, -v) for v, c, s in best]
    assert sorted((r.query_id, r.chat_id, r.seq, r.score) for r in got) == sorted(want)


def test_fuzzy_vocabulary_equals_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("ab\u00e9d", k=rng.randrange(2, 7)))
    keys, vocab = {word() for _ in range(150)}, {w for w in (word() for _ in range(400)) if len(w) > 2}
    got = search.fuzzy_vocabulary(
        spark.createDataFrame([(k,) for k in keys], "keyword string"),
        spark.createDataFrame([(w,) for w in vocab], "word string"),
    )
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(k, w) for k in keys for w in vocab if k != w and (k in w or w in k) and jaccard(k, w) > 0.5}
    rows = [(r.keyword, r.word) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_few_candidates_are_checked(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, n)))
    keys, vocab = {word(6) for _ in range(200)}, {word(14) for _ in range(3000)} | {"a", "ab", "abc"}
    tables = (
        spark.createDataFrame([(k,) for k in keys | {"ab", "zz", ""}], "keyword string"),
        spark.createDataFrame([(w,) for w in vocab], "word string"),
    )
    pairs = [(r.keyword, r.word) for r in search.fuzzy_candidates(*tables).collect()]
    assert len(pairs) == len(set(pairs))
    ratio = lambda a, b: min(len(set(a)), len(set(b))) / max(len(set(a)), len(set(b)))
    assert all(ratio(k, w) > 0.5 for k, w in pairs)
    heads = sum(k[:3] in w or w[:3] in k for k in keys for w in vocab)
    found = {(r.keyword, r.word) for r in search.fuzzy_vocabulary(*tables).collect()}
    assert found <= set(pairs) and found and len(pairs) < heads / 2


def tfidf_by_hand(texts):
    def grams(t):
        toks = [w for w in t.split() if len(w) > 1]
        return Counter(" ".join(toks[i : i + n]) for n in (1, 2, 3) for i in range(len(toks) - n + 1))

    counts = [grams(t) for t in texts]
    df = Counter(g for c in counts for g in c)
    n = len(texts)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in df.items() if 2 <= d <= 0.9 * n}

    def vector(c):
        w = {g: k * idf[g] for g, k in c.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / norm for g, v in w.items()}

    return grams, vector, [vector(c) for c in counts]


def test_tfidf_equals_brute_force(spark, talk):
    rows = talk.orderBy("seq").collect()
    grams, vector, vectors = tfidf_by_hand([r.message for r in rows])
    terms = index.tfidf_vocabulary(talk)
    weights = index.tfidf_weights(talk, terms)
    got = {(r.seq, r.term): r.weight for r in weights.collect()}
    want = {(r.seq, g): w for r, v in zip(rows, vectors) for g, w in v.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    hits = search.tfidf_search(weights, terms, search.one_query(spark, "The thing in dinner"), k=5)
    qv = vector(grams("the thing in dinner"))
    scored = [(-round(sum(qv.get(g, 0) * w for g, w in v.items()), 9), r.chat_id, r.seq) for r, v in zip(rows, vectors)]
    best = sorted(s for s in scored if -s[0] > 0.01)[:5]
    got = sorted((-h.score, h.chat_id, h.seq) for h in hits.collect())
    assert [g[1:] for g in got] == [b[1:] for b in best]
    assert [g[0] for g in got] == pytest.approx([b[0] for b in best])


def test_capped_vocabulary_and_norms(spark, talk):
    terms = index.tfidf_vocabulary(talk, max_features=5)
    assert terms.count() == 5
    norms = index.tfidf_weights(talk, terms, max_features=None).groupBy("chat_id", "seq").agg(
        F.sum(F.col("weight") ** 2).alias("n")
    )
    assert all(abs(r.n - 1) < 1e-9 for r in norms.collect())


@pytest.mark.parametrize("block", [2, 4096])
def test_semantic_search_equals_numpy(spark, block, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(500, 16)).astype(np.float32)
    m[100:300] = m[7]  # a large group of copies
    m[400] = 0
    q = rng.normal(size=(5, 16)).astype(np.float32)
    q[0] = m[7]
    vectors = spark.createDataFrame(
        [(f"c{i % 2}", i, m[i].tolist()) for i in range(500)], "chat_id string, seq long, vector array<float>"
    ).repartition(7)
    queries = spark.createDataFrame([(str(i), q[i].tolist()) for i in range(5)], "query_id string, vector array<float>")
    hits = search.semantic_search(vectors, queries, k=9)
    plan = plan_of(hits)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.query_id, -r.score, r.chat_id, r.seq) for r in hits.collect())
    md, qd = m.astype(float), q.astype(float)
    norms = np.linalg.norm(md, axis=1, keepdims=True)
    unit = np.divide(md, norms, out=np.zeros_like(md), where=norms > 0)
    cos = np.round(unit @ (qd / np.linalg.norm(qd, axis=1, keepdims=True)).T, 9)
    want = []
    for j in range(5):
        ranked = sorted((-cos[i, j], f"c{i % 2}", i) for i in range(500) if cos[i, j] > 0.1)
        want += [(str(j), *r) for r in ranked[:9]]
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)])


def test_few_rows_and_no_queries(spark):
    vectors = spark.createDataFrame([("c", 1, [1.0, 0.0])], "chat_id string, seq long, vector array<float>")
    one = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<float>")
    assert search.semantic_search(vectors, one, k=15).count() == 1
    assert search.semantic_search(vectors, one.limit(0)).count() == 0
    blank = spark.createDataFrame([("q", " \u00a0")], "query_id string, text string")
    assert search.keywords_of(blank).count() == 0 and search.asked(blank).count() == 0


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id string, chat_id string, seq long, score double")
    fused = search.fuse(
        {
            search.SEMANTIC: hits([("q", "c", 1, 0.5), ("q", "c", 2, 0.4)]),
            search.KEYWORD: hits([("q", "c", 1, 2.0)]),
            "other": hits([("q", "c", 3, 0.2)]),
        },
        k=1,
    )
    got = {r.seq: r.score for r in fused.collect()}
    assert got == {1: round((0.5 + 1.6) / 1.8 + 0.2, 6), 2: 0.5}


def test_combined_search_is_stable_under_repartition(spark, talk):
    t = index_store.in_memory(talk)
    again = index_store.in_memory(talk.repartition(5, "message"))
    queries = search.one_query(spark, "the thing in dinner abc")
    rows = lambda x: sorted(map(tuple, search.combined_search(x, queries, k=6).collect()))
    first = rows(t)
    assert len(first) <= 12 and first == rows(again)
    assert all(r[3] >= 0.1 for r in first)


def test_salted_join_equals_broadcast(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, i * 1.5) for i in range(5)], "k long, w double")
    a = join_small(big, small, ["k"], ["id"])
    b = join_small(big, small, ["k"], ["id"], max_rows=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_index_store_follows_the_messages(spark, talk, tmp_path):
    path = str(tmp_path)
    assert index_store.find(talk, path) is None
    version = index_store.build(talk, path)
    assert index_store.find(talk.repartition(3), path) == version
    changed = talk.withColumn("message", F.when(F.col("seq") == 3, "new").otherwise(F.col("message")))
    assert index_store.find(changed, path) is None
    stored = index_store.build_or_load(talk, path)
    assert stored.postings.count() == index.word_postings(talk).count()
    index_store.clear(spark, path)
    assert index_store.find(talk, path) is None


def test_stored_search_reads_only_matching_row_groups(spark, talk, tmp_path):
    t = index_store.load(talk, index_store.build(talk, str(tmp_path)))
    plan = plan_of(t.postings.where(F.col("word") == "the"))
    assert "EqualTo(word,the)" in plan


def test_user_encoder_and_emotions(spark, chat):
    df = chat([("c", 0, 0, "a", "joy"), ("c", 1, 1, "a", "anger anger"), ("c", 2, 2, "b", "zzz")])

    def factory():
        def encode(texts):
            return np.asarray([[t.lower().count("joy"), t.lower().count("anger"), 1.0] for t in texts])

        return encode

    vectors = embed.embed(df, "message", factory, batch_size=2).select("chat_id", "seq", "user", "vector")
    labels = embed.emotion_labels(spark, ["Joy", "Anger", "Other"], factory)
    scored = embed.emotion_scores(vectors, "vector", labels)
    got = {r.seq: r.dominant_emotion for r in scored.collect()}
    assert got == {0: "Joy", 1: "Anger", 2: "Other"}


def test_first_label_wins_ties(spark, chat):
    df = embed.embed(chat([("c", 0, 0, "a", "unrelated words")]), "message").select("seq", "vector")
    scored = embed.emotion_scores(df.withColumn("vector", F.transform("vector", lambda x: x * 0)), "vector", embed.emotion_labels(spark))
    assert scored.first().dominant_emotion == embed.EMOTIONS[0]


def test_an_uncapped_index_and_its_identity(spark, talk, tmp_path):
    path = str(tmp_path)
    small = index_store.IndexOptions(max_features=3)
    whole = index_store.IndexOptions(ngram_range=(1, 1), min_df=1, max_df=1.0, max_features=None)
    assert index_store.build_or_load(talk, path, small).terms.count() == 3
    assert index_store.find(talk, path) is None and index_store.find(talk, path, options=small)
    tables = index_store.build_or_load(talk, path, whole)
    words = {w for r in talk.collect() for w in r.message.split() if len(w) > 1}
    assert {r.term for r in tables.terms.collect()} == words
    with pytest.raises(ValueError, match="name"):
        index_store.IndexOptions(encoder_name="x").mark()


def test_a_callers_encoder_reaches_the_stored_index(spark, talk, tmp_path):
    def factory():
        return lambda texts: np.asarray([[t.count("thing"), t.count("ab"), 1.0] for t in texts])

    own = index_store.IndexOptions(encoder_name="counts", encoder_factory=factory)
    tables = index_store.build_or_load(talk, str(tmp_path), own)
    assert len(tables.vectors.first().vector) == 3
    hits = search.combined_search(tables, search.one_query(spark, "thing thing"), k=3)
    assert hits.count() > 0


def test_ragged_vectors_raise(spark):
    rows = [("c", 1, [1.0, 0.0, 0.0]), ("c", 2, [1.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chat_id string, seq long, vector array<float>").coalesce(1)
    one = spark.createDataFrame([("q", [1.0, 1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    with pytest.raises(Exception, match="different lengths"):
        search.semantic_search(vectors, one).collect()


def test_many_labels_are_scored_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    labels = [(i, f"l{i}", rng.normal(size=4).astype(np.float32).tolist()) for i in range(23)]
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    table = spark.createDataFrame(labels, "ord int, label string, vector array<float>")
    df = spark.createDataFrame(rows, "id int, vector array<float>")
    one = {r.id: (r.dominant_emotion, r.emotion_similarities) for r in embed.emotion_scores(df, "vector", table).collect()}
    monkeypatch.setattr(embed, "LABEL_BLOCK", 5)
    monkeypatch.setattr(embed, "VECTOR_BLOCK", 15)
    many = {r.id: (r.dominant_emotion, r.emotion_similarities) for r in embed.emotion_scores(df, "vector", table).collect()}
    assert one == many and len(one[0][1]) == 23


def test_many_labels_leave_the_plan_as_it_is(spark):
    rng = np.random.default_rng(3)
    n = 25_000
    vectors = rng.normal(size=(n, 3)).astype(np.float32)
    vectors[20_000] = vectors[12_345]  # the first of two equal labels wins
    flat = pa.table({"ord": np.arange(n), "label": [f"l{i}" for i in range(n)], "vector": list(vectors)})
    labels = spark.createDataFrame(flat)
    df = spark.createDataFrame([(1, vectors[12_345].tolist()), (2, vectors[777].tolist())], "id int, vector array<float>")
    scored = embed.emotion_scores(df, "vector", labels)
    got = {r.id: (r.dominant_emotion, len(r.emotion_similarities)) for r in scored.collect()}
    assert got == {1: ("l12345", n), 2: ("l777", n)}
    assert len(plan_of(scored)) < 20_000


def test_a_failing_branch_leaves_the_others(spark, talk):
    def factory():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    plain = index_store.in_memory(talk)
    broken = dataclasses.replace(plain, encode=lambda df, column: embed.embed(df, column, factory))
    queries = search.one_query(spark, "the thing in dinner")
    hits, status = search.combined_search_by_branch(broken, queries, k=5)
    told = {r.branch: r.error for r in status.collect()}
    assert "no model" in told.pop(search.SEMANTIC) and set(told.values()) == {None}
    parts = {
        search.KEYWORD: search.keyword_search(plain.postings, plain.vocabulary, queries, 5),
        search.TFIDF: search.tfidf_search(plain.weights, plain.terms, queries, 5),
    }
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, search.fuse(parts, 5).collect()))
    whole, status = search.combined_search_by_branch(plain, queries, k=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, search.combined_search(plain, queries, 5).collect()))
    assert status.where("error IS NOT NULL").count() == 0


def test_errors_of_the_plan_are_raised(spark, talk):
    plain = index_store.in_memory(talk)
    wrong = dataclasses.replace(plain, terms=plain.terms.drop("idf"))
    with pytest.raises(AnalysisException):
        search.combined_search_by_branch(wrong, search.one_query(spark, "the thing"))
