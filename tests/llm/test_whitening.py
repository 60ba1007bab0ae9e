"""Whitening against plain numpy on whole numbers, and edge rows."""

import math

import numpy as np
import pytest

from quire.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 5) for i, v in rows], SCHEMA)


def plain(vectors, counts=None):
    """n, exact deviations, whitened up to sign and explained of each distinct grid vector."""
    xs = {}
    for v in vectors:
        x = tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)
        xs[x] = xs.get(x, 0) + 1
    weights = {x: n if counts else 1 for x, n in xs.items()}
    n = sum(weights.values())
    sums = [sum(w * x[j] for x, w in weights.items()) for j in range(len(next(iter(xs))))]
    d = np.array([[n * a - s for a, s in zip(x, sums)] for x in xs], float) / n
    cov = (d * np.array(list(weights.values()))[:, None]).T @ d / n
    e, u = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-e, kind="stable")[:16] if e[i] > 1e-10]
    dev = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs}
    return n, dev, {x: d[i] @ u[:, order] / np.sqrt(e[order]) for i, x in enumerate(xs)}, e[order] / np.trace(cov)


@pytest.mark.parametrize("by_count", [False, True])
def test_against_plain(spark, by_count):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(90, 20)) * np.linspace(3, 1, 20)
    vectors = [base[i].tolist() for i in [*range(90), *[7] * 200, 3, 3]]
    got = whitening.whiten(frame(spark, list(enumerate(vectors))), by_count=by_count).collect()
    assert len(got) == len(vectors) * 16
    n, dev, white, explained = plain(vectors, by_count)
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        x = tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vectors[r.vec_id])
        want = white[x][r.component - 1]
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert r.n == n and r.deviation == dev[x] and abs(r.whitened - sign * want) < 1e-7
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, -inf], [], [1e30, 1.0], [2.0] * 3]
    good = [[0.0, 0.0], [1.0, 0.5], [1.0, 0.5], [-2.0, 4.0]]
    got = whitening.whiten(frame(spark, [(None, good[0]), *enumerate(bad + good)])).collect()
    # The lone vector of another length has no variance.
    assert sorted({r.vec_id for r in got}, key=lambda v: (v is not None, v)) == [None, 8, 9, 10, 11]
    assert all(r.n == 3 and r.component in (1, 2) for r in got) and len(got) == 10
    n, dev, _, _ = plain(good)
    assert {r.deviation for r in got} == set(dev.values())
    # Two lengths are two fits.
    two = whitening.whiten(frame(spark, list(enumerate([*good, [1.0, 2.0, 3.0], [2.0, 0.0, 1.0]])))).collect()
    assert {(r.vec_id, r.n) for r in two} == {(0, 3), (1, 3), (2, 3), (3, 3), (4, 2), (5, 2)}
    assert {r.component for r in two if r.vec_id == 4} == {1}
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []


def test_large_numbers(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [v, 1.0]) for i, v in enumerate([1e16, -1e16, 5e15])], "vec_id long, embedding array<double>"))
    assert {(r.vec_id, r.deviation, r.n) for r in got.collect()} == {(i, None, 3) for i in range(3)}


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    vectors = [*rng.normal(size=(50, 3)).tolist(), *[[1.0, 2.0, 3.0]] * 3000]
    got = whitening.whiten(frame(spark, list(enumerate(vectors))))
    assert got.count() == 3050 * 3 and got.select("n").distinct().collect() == [(51,)]
