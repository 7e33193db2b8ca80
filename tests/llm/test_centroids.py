"""Centroid clusters against a plain computation."""

import hashlib

import numpy as np
import pytest

from convolens.llm import centroids


def brute(vectors, k, rounds, scale=256):
    """``vectors`` as ``(id, components)``; every row that takes part, in their order."""
    whole = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors]
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    middle = [v for _, _, v in sorted((name(i), i, v) for i, v in whole)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    best = lambda v: min((far(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(best(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(middle)]
    return sorted((i, best(v)[1], best(v)[0]) for i, v in whole), middle


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "extra") for i, v in rows],
                                 "vec_id long, embedding array<double>, cluster string")


@pytest.mark.parametrize("k, n", [(5, 400), (40, 30), (1, 7)])
def test_clusters(spark, k, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(i % 4, 0.4, 6).round(2).tolist()) for i in range(n)]
    rows += [(n + 1, rows[0][1]), (0, rows[1][1]), (0, rows[0][1])]  # equal vectors and a repeated id
    found = centroids.cluster(table(spark, rows), k=k, rounds=5, dimensions=6)
    want, middle = brute(rows, k, 5)
    assert sorted(map(tuple, found.assignment.collect())) == want
    assert found.centroids.tolist() == middle
    summary = {r.cluster: r for r in found.summary().collect()}
    assert {r.inertia for r in summary.values()} == {sum(d for _, _, d in want)}
    for c, r in summary.items():
        assert r.cluster_inertia == sum(d for _, j, d in want if j == c)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()


def test_rows_that_take_no_part(spark):
    good = [0.5, -0.001, 2.0]
    odd = [None, [], [1.0, 2.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1e9, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(10, good), (None, good), (11, [0.0, 0.0, 0.0])]
    found = centroids.cluster(table(spark, rows), k=2, dimensions=3)
    got = sorted(map(tuple, found.assignment.collect()), key=repr)
    assert [g[0] for g in got] == [10, 11, None] and got[0][1:] == got[2][1:]
    assert sorted(found.centroids.tolist()) == [[0, 0, 0], [128, -1, 512]]
    empty = centroids.cluster(table(spark, rows[:7]), dimensions=3)
    assert empty.assignment.count() == 0 and empty.summary().count() == 0


def test_blocks_keep_every_vector():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q = rng.integers(-300, 300, (50, 4))
    codes, values = zip(*[(c, v) for v, c in (np.unique(x, return_inverse=True) for x in q.T)])
    block = centroids.Block(pa.array(range(50)), np.stack(codes).astype("<u2"), list(values))
    middle = rng.integers(-300, 300, (3, 4))
    far = ((q[:, None, :] - middle[None]) ** 2).sum(2)
    assert (block.distances(middle) == far).all()
    total, n = block.sums(far.argmin(1), 3)
    assert (total == [q[far.argmin(1) == j].sum(0) for j in range(3)]).all() and n.sum() == 50
