"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from convolens.llm import runs

SF_DIR = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Maximal stretches of every period, the smallest period of each stretch."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            if words[x] != words[x + p]:
                x += 1
                continue
            start = x
            while x + p < n and words[x] == words[x + p]:
                x += 1
            if x + p - start >= max(least, 2 * p):
                out.setdefault((start, x + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def odd_texts(rng, count):
    texts = []
    for _ in range(count):
        n, letters = rng.choice([0, 1, 2, 11, 12, 13, 40, 100, 200]), rng.choice([1, 2, 3, 10, 50])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.7:
            a, p = rng.randrange(n // 2), 1 + rng.randrange(n // 3)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        texts.append(words)
    return texts


def test_difference_cover():
    shifts = {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER}
    assert shifts == set(range(runs.MODULUS))


@pytest.mark.parametrize("least, pairs", [(12, runs.PAIRS), (12, 50), (2, 2000), (5, 2000)])
def test_runs_of_many_texts(least, pairs):
    texts = odd_texts(random.Random(least + pairs), 120)
    got = [[tuple(map(int, r)) for r in found] for found in runs.runs_of(texts, least, pairs)]
    assert got == [brute_runs(t, least) for t in texts]


def test_fibonacci_words_have_runs_of_many_periods():
    a, b = ["x"], ["x", "y"]
    for _ in range(10):
        a, b = b, b + a
    [found] = runs.runs_of([[w.encode() for w in b]])
    assert [tuple(map(int, r)) for r in found] == brute_runs(b) and len(found) > 20


def test_one_word_many_times():
    [found] = runs.runs_of([[b"same"] * 60_000])
    assert found.tolist() == [[0, 60_000, 1]]


def test_common_extensions():
    rng = np.random.default_rng(2)
    words = np.r_[rng.integers(1, 3, 700), rng.integers(1, 3, 30).repeat(1)]
    words = np.r_[words, words[:400], [99]].astype(np.int64)
    lcp = runs.Extensions(words, np.zeros(len(words), np.int64))
    i, j = rng.integers(0, len(words), (2, 3000))
    i, j = i[i != j], j[i != j]

    def brute(a, b):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        return n

    assert lcp.common(i, j).tolist() == [brute(a, b) for a, b in zip(i, j)]


def test_rows_of_every_kind(spark):
    loop = "a b c " * 8 + "end"
    rows = [(1, loop, 1.5), (1, loop, 1.5), (None, "x\ty\n" * 9, None), (2, None, 0.0), (3, "", 0.0), (4, " \r\n ", 0.0), (5, "één woord ja", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs double")
    got = sorted(runs.find_runs(df).collect(), key=repr)
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "n_words", "runs", "collapsed"}
    by_id = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by_id[1].runs] == [(0, 24, 3)] and by_id[1].collapsed == "a b c end"
    assert by_id[None].collapsed == "x y" and by_id[None].n_words == 18
    assert [(by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) for i in (2, 3, 4)] == [(0, [], "")] * 3
    assert by_id[5].n_words == 2 and by_id[5].collapsed == rows[-1][1]
    assert runs.find_runs(df.limit(0)).count() == 0


def test_text_column_may_have_an_added_name(spark):
    df = spark.createDataFrame([("a b " * 10,)], "collapsed string").withColumnRenamed("collapsed", "words")
    assert runs.find_runs(df, text="words").first().n_words == 20


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, n, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    columns = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, entry.queries()["op11_periodic_runs"](spark, SF_DIR).select(columns).collect()))
    small = {i: t for i, t in texts.items() if len(t or "") < 40_000}
    assert len(got) == len(texts) and len(small) > 100
    assert [g for g in got if g[0] in small] == sorted(expected(i, t) for i, t in small.items())
    assert sum(g[2] > 0 for g in got) > 5
