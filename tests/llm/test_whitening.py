"""Operator 11 against numpy's eigenvectors and exact whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.llm import queries, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, n string, x int, component string, deviation int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, "n", 1, "c", 2) for i, v in data], SCHEMA).repartition(3)


def direct(data):
    """The definition, row by row."""
    sound = [(i, v) for i, v in data if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    xs = [(i, tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v)) for i, v in sound]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return xs, n, sums, v, e[::-1], u[:, ::-1]


def close(data, rows, k=16):
    xs, n, sums, v, e, u = direct(data)
    k = min(k, int((e > e[0] * 1e-10).sum()))
    assert len(rows) == len(xs) * k
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    mean = [Fraction(s, n) for s in sums]
    for c in range(1, k + 1):
        want, got = [], []
        for i, x in xs:
            w = float(np.dot([float(a - m) for a, m in zip(x, mean)], u[:, c - 1]) / np.sqrt(e[c - 1]))
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert dev in [r.deviation for r in by[i, c]]
            same = [r for r in by[i, c] if r.deviation == dev]
            want.append(abs(w))
            got.append(min((abs(r.whitened) for r in same), key=lambda g: abs(g - abs(w))))
            assert same[0].n == n and abs(same[0].explained / (e[c - 1] / np.trace(v)) - 1) < 1e-9
        assert np.allclose(got, want, atol=1e-7)


def test_whole_table(spark):
    data = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    close(data, queries.op11_whitening(spark, SF).collect())


def test_odd_rows(spark):
    rng = np.random.RandomState(1)
    data = [(i, [float(a) for a in rng.normal(0, 1, 5)]) for i in range(30)]
    data += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [NAN] + [0.0] * 4), (103, [INF] + [0.0] * 4), (None, data[0][1]), (3, data[7][1]), (3, data[7][1])]
    got = whitening.components(frame(spark, data + [(104, []), (105, [1.0])]), k=4).collect()
    close(data, got, 4)
    assert {r.vec_id for r in got} == {*range(30), None}


def test_copies_count_once(spark):
    rng = np.random.RandomState(2)
    data = [(i, [float(a) for a in rng.normal(0, 1, 3)]) for i in range(9)]
    many = data + [(1000 + i, data[0][1]) for i in range(500)]
    model, few = (whitening.fit_whitening(frame(spark, d)) for d in (many, data))
    assert model.n == few.n == 9 and model.sums == few.sums and np.allclose(model.components, few.components)


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_fit(spark, data):
    out = whitening.components(frame(spark, data))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank(spark):
    data = [(i, [float(i), float(2 * i), 5.0, float(i * i)]) for i in range(12)]
    out = whitening.components(frame(spark, data)).collect()
    assert {r.component for r in out} == {1, 2} and abs(sum(r.explained for r in out if r.vec_id == 0) - 1) < 1e-12
    close(data, out)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_factor(d):
    rng = np.random.RandomState(d)
    base = rng.normal(0, 1, (3 * d, d)) * np.logspace(0, -6, d)
    a = base.T @ base
    g = whitening.cholesky(a)
    assert np.allclose(g @ g.T, a, rtol=1e-12, atol=1e-12 * a.max())
    values, units = whitening.jacobi(g)
    assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.svd(base, compute_uv=False)[: len(values)] ** 2, rtol=1e-9)
    assert len({frozenset(p) for pair in whitening.rounds(d) for p in zip(*map(np.ndarray.tolist, pair))}) == d * (d - 1) // 2


def test_large_deviation():
    x = np.array([[2**40, 0], [1, 1]])
    assert whitening.deviations(x, 3, (2**40 + 1, 1)) == [None, None]
    assert whitening.deviations(x[1:], 2**33, (2**33 + 5, 2**33)) == [25]
    assert whitening.deviations(x // 2**20, 3, (5, 1)) == [(3 * 2**20 - 5) ** 2 + 1, 26]
