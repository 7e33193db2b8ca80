"""Nearest neighbours and embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard string"


def frame(spark, rows):
    """Vectors with extra columns whose names clash with helper columns."""
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def bad_rows(first):
    nan = float("nan")
    return [
        (first, None),
        (first + 1, []),
        (first + 2, [0.0] * 8),
        (first + 3, [1.0, None] + [0.0] * 6),
        (first + 4, [nan] + [1.0] * 7),
        (first + 5, [float("inf")] + [1.0] * 7),
        (None, [1.0] * 8),
    ]


def vectors(n, seed=3):
    return np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)


def test_nearest_against_brute_force(spark):
    x = vectors(300)
    x[250:] = x[7]  # a hot vector; ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad_rows(1000)
    got = {}
    for r in ann.nearest(frame(spark, rows), every=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    wide = x.astype(np.float64)
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    found = 0
    for q, hits in got.items():
        far = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        best = sorted((far[i], i) for i in range(300) if i != q)[:10]
        assert sorted(hits) == list(range(1, 11))
        assert all(s == pytest.approx(far[i], abs=1e-12) for i, s in hits.values())
        found += len({i for _, i in best} & {i for i, _ in hits.values()})
    assert found >= 0.9 * 60
    assert [got[250][r][0] for r in range(1, 11)] == [7, *[i for i in range(251, 260)]]


def test_few_and_no_vectors(spark):
    few = frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8), (2, [1.0] * 8)])
    assert [(r["rank"], r.vec_id) for r in ann.nearest(few, every=100).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(frame(spark, []), every=100).count() == 0
    assert ann.nearest(frame(spark, bad_rows(0)), every=1).count() == 0


def test_mixed_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="lengths 1 to 2"):
        ann.nearest(frame(spark, [(0, [1.0]), (1, [1.0, 2.0])]), every=1)


def brute_groups(rows, threshold):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows}
    ids = sorted(ok)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            x, y = ok[a], ok[b]
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                near[a].add(b)
    comp = dict(zip(ids, ids))
    while True:
        new = {i: min([comp[i], *[comp[j] for j in near[i]]]) for i in ids}
        if new == comp:
            return {i: (len(near[i]), comp[i]) for i in ids}
        comp = new


def test_embedding_groups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = vectors(60)
    near = base[:20] + rng.normal(scale=0.05, size=(20, 8)).astype(np.float32)
    hot = base[3] + rng.normal(scale=0.03, size=(90, 8)).astype(np.float32)  # larger than the window
    x = np.concatenate([base, near, hot, base[:5], 2 * base[5:8]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, [1.0, 0.0]), (901, [1.0, 0.01])]
    want = brute_groups(rows, 0.95)
    df = frame(spark, rows + bad_rows(2000))
    got = embed_dedup.near_duplicates(df, paired=8, tile=32).collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 2000}
    assert found == want
    assert len(got) == df.count()
    rest = [r for r in got if r.vec_id is None or r.vec_id >= 2000]
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in rest)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_links_between_many_that_are_not(spark):
    """Pairs just above the threshold, inside a crowd of distinct vectors just below it."""
    rng = np.random.default_rng(6)
    dim, crowd, pairs = 64, 1200, 300
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    away = lambda m, cos, d: unit(cos * m + np.sqrt(1 - cos**2) * unit(d - (d * m).sum(1, keepdims=True) * m))
    center = unit(rng.normal(size=(1, dim)))
    x = away(np.repeat(center, crowd, 0), 0.95, rng.normal(size=(crowd, dim)))
    near = away(x[:pairs], 0.952, rng.normal(size=(pairs, dim)))
    x = np.concatenate([x, near]).astype(np.float32).astype(np.float64)
    cos = unit(x) @ unit(x).T
    links = (cos >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert links.sum() >= 2 * pairs
    got = embed_dedup.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.sum(1).tolist()))


def close_pairs(n, pairs, dim=32):
    rng = np.random.default_rng(7)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))
    aside = rng.normal(size=(pairs, dim))
    aside = unit(aside - (aside * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    return np.concatenate([x, 0.953 * x[:pairs] + np.sqrt(1 - 0.953**2) * aside])


def test_passes_miss_no_pair_among_many_blocks(spark):
    x = close_pairs(3000, 400)
    cos = x @ x.T
    want = (cos >= 0.95).sum(1) - 1
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = embed_dedup.near_duplicates(df, window=64).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


def test_vectors_meet_a_bounded_number_of_blocks(spark, monkeypatch):
    """Spread vectors are sent to three blocks a pass, a few more where a run is long, at any size."""
    sent = []
    monkeypatch.setattr(embed_dedup, "_pairs", lambda met, *_: sent.append(met.count()) or met.select("rep", F.col("rep").alias("root")))
    for n in (1000, 4000):
        rows = [(i, 8, 1, v.tolist()) for i, v in enumerate(vectors(n))]
        classes = spark.createDataFrame(rows, "rep long, dim int, n long, v array<double>")
        embed_dedup.pass_links(classes, 0.95, 64, 1e-6)
    bits = [np.ceil(np.log2(n / 64)) + 1 for n in (1000, 4000)]
    turns = [np.ceil(np.log(1e-6) / np.log1p(-((1 - np.arccos(0.95) / np.pi) ** b))) for b in bits]
    assert sent[0] <= 6 * turns[0] * 1000 and sent[1] <= 6 * turns[1] * 4000


def test_embedding_groups_of_nothing(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])])
    got = sorted((r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1)]
