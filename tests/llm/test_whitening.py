"""Whitening: polynomial, roots and vectors against plain versions, whole results against floating-point whitening of the distinct vectors."""

import math

import numpy as np
import pytest
from test_llm import rows_of

from foliant.llm import charpoly
from foliant.llm.charpoly import Root, largest_roots, vectors_of
from foliant.llm.queries import QUERIES
from foliant.llm.whitening import characteristic_polynomial, digits, packed, products, unpacked, whitened

FOLDER = "/root/testdata/sf0.01"


def scatter(z):
    z = np.array(z, object)
    return (len(z) * z.T.dot(z) - np.outer(z.sum(0), z.sum(0))).tolist()


def plain_polynomial(m):
    """Faddeev and LeVerrier's rule in whole numbers, constant first."""
    n, a = len(m), np.array(m, object)
    out, step = [1], np.zeros((n, n), object)
    unit = np.zeros((n, n), object)
    unit[np.arange(n), np.arange(n)] = 1
    for k in range(1, n + 1):
        step = a.dot(step) + out[-1] * unit
        out.append(-int(np.trace(a.dot(step))) // k)
    return out[::-1]


def test_polynomial_by_remainders(spark):
    rng = np.random.default_rng(1)
    for dim, size, rows in ((1, 5, 9), (2, 9, 20), (7, 1000, 30), (7, 9, 4), (12, 2**45, 40)):
        m = scatter(rng.integers(-size, size, (rows, dim)).tolist())
        assert characteristic_polynomial(spark, m) == plain_polynomial(m)
    zeros = [[0] * 5 for _ in range(5)]
    assert characteristic_polynomial(spark, zeros) == [0, 0, 0, 0, 0, 1]
    swapped = scatter([[0, 0, 1, 0], [0, 0, -1, 0], [1, 0, 0, 1], [-1, 0, 0, -1]])  # pivots out of order
    assert characteristic_polynomial(spark, swapped) == plain_polynomial(swapped)


def test_repeated_and_close_roots():
    def of(*roots):
        f = [1]
        for r in roots:
            f = [a - r * b for a, b in zip([0, *f], [*f, 0])]
        return f

    def values(f, most=99):
        return [(r.at(r.bits) / 2**r.bits, r.times) for r in largest_roots(f, most)]

    assert values(of(0, 0, 3, 3, 3, 7, 10, 10)) == [(10, 2), (7, 1), (3, 3)]
    assert values(of(10**12, 10**12 + 1, 10**12 + 1, 5)) == [(10**12 + 1, 2), (10**12, 1), (5, 1)]
    assert values(of(1, 2, 3, 4, 5, 5), 3) == [(5, 2), (4, 1)] and values(of(0, 0)) == [] and values([1]) == []
    got = values([1, -10**6, 1])  # roots that no whole number separates from zero
    assert [t for _, t in got] == [1, 1] and got[1][0] == pytest.approx(1e-6, rel=1e-9)


def test_vectors_of_repeated_roots():
    m = scatter(np.vstack([3 * np.eye(5, 6), -3 * np.eye(5, 6), 0 * np.eye(1, 6)]).astype(int).tolist())
    (root,) = largest_roots(plain_polynomial(m), 16)
    assert root.times == 5
    v = vectors_of(m, root)
    assert np.abs(v @ v.T - np.eye(5)).max() < 1e-14 and np.abs(v[:, 5]).max() < 1e-14
    assert np.abs(np.array(vectors_of([[4]], Root(4, 4, 0)))).tolist() == [[1.0]]


def test_sums_are_exact():
    rng = np.random.default_rng(4)
    for top in (5, 2**19, 2**21, 2**40, 2**61):
        z = rng.integers(-top, top, (50, 4))
        z[0] = (-2**62, 2**62, 0, -1) if top == 2**61 else z[0]
        o = z.astype(object)
        assert (products(z) == o.T.dot(o)).all()
        assert (unpacked(packed(z), 4) == z).all()
    assert len(packed(np.array([[127, -128]]))[0]) == 3 and len(packed(np.array([[128, 0]]))[0]) == 5
    for x in (0, -1, 5, 2**40, -2**40, 2**200 + 7, -2**200 - 7):
        assert sum(d << 40 * k for k, d in digits(x)) == x and all(abs(d) <= 2**40 for _, d in digits(x))


def check(rows, got, most=16):
    """Rows of (key, vector) against whitening by numpy in doubles."""
    x = {}
    usable = []
    for key, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            z = tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)
            x[z] = None
            usable.append((key, z))
    fit = np.array(list(x), object)
    n, sums = len(fit), fit.sum(0)
    v = np.array(scatter(fit - 1_000_000), float) / n**2
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()) if e[0] > 0 else 0)
    assert len(got) == k * len(usable)
    y = {}
    for r in got:
        y.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9) and 0 <= r["identity_error"] < 1e-9
    one, two = [], []
    for key, z in usable:
        d = np.array([n * a - s for a, s in zip(z, sums)], object)
        w = y[key, int((d * d).sum())]
        one.append([w[c + 1].pop() for c in range(k)])
        two.append((d / n).astype(float) @ u[:, :k] / np.sqrt(e[:k]))
    one, two = np.array(one), np.array(two)
    sign = np.sign((one * two).sum(0))
    assert np.abs(one * sign - two).max() < 1e-6


def test_against_floating_point(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 6)).astype(np.float32) @ np.diag([5, 3, 2, 1, 0.5, 0.2]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies count once in the fit
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5)]
    frame = spark.createDataFrame([(k, v, 1, 2, "p") for k, v in rows], "vec_id long, embedding array<float>, component int, n int, packed string").repartition(4)
    check(rows, rows_of(whitened(frame)))
    check(rows, rows_of(whitened(frame, most=3)), 3)
    doubles = [(k, [c * 1e9 for c in v]) for k, v in rows[:60]]
    check(doubles, [{**r, "deviation": int(r["deviation"])} for r in rows_of(whitened(spark.createDataFrame(doubles, "vec_id long, embedding array<double>")))])


def test_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    assert whitened(frame([])).count() == 0
    assert whitened(frame([(1, None), (2, [])])).count() == 0
    assert whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    got = rows_of(whitened(frame([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0])])))
    assert len(got) == 3 and {abs(round(r["whitened"], 12)) for r in got} == {1.0} and {r["n"] for r in got} == {2}
    got = rows_of(whitened(frame([(1, [1.0, 2.0]), (2, [2.0, 2.5]), (3, [0.5, 1.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])])))
    assert {r["vec_id"] for r in got} == {1, 2, 3}  # one length
    got = rows_of(whitened(frame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])))
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4} and {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-9 for r in got)
    equal = frame([(i, [float(2 * (i == j)) - 2.0 * (i == j + 4) for j in range(4)]) for i in range(8)])  # four equal eigenvalues
    got = rows_of(whitened(equal))
    assert len(got) == 32 and all(abs(r["explained"] - 0.25) < 1e-12 and r["identity_error"] < 1e-12 for r in got)


def test_whole_table(spark):
    got = QUERIES["op12_whitening"](spark, FOLDER)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(rows, rows_of(got))


def test_primes():
    few = [p for p, _ in zip(charpoly.primes(), range(20))]
    assert few[0] == 2**31 - 1 and all(p > 2**30 and all(p % k for k in range(2, 50_000)) for p in few)
