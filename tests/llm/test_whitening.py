"""Operator 12 against plain integer and double computations."""

import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.q_whitening import op12_whitening
from quire.llm.whitening import (
    characteristic_polynomial, greatest_roots, null_space, outer_sums, packed, polynomial_mod, primes_above, unpacked, whiten)


def plain_polynomial(m):
    """Faddeev and LeVerrier's recursion in integers."""
    n = len(m)
    eye = np.array([[int(i == j) for j in range(n)] for i in range(n)], dtype=object)
    out, a = [1], eye * 0
    for k in range(1, n + 1):
        a = m.dot(a + eye * out[-1])
        out.append(-sum(a[i, i] for i in range(n)) // k)
    return out


def scatter_matrix(rng, n, dim, spread=300):
    x = np.floor(rng.normal(size=(n, dim)) * spread * np.linspace(1, 2, dim)).astype("int64").astype(object)
    s = x.sum(axis=0)
    return n * x.T.dot(x) - np.outer(s, s)


def test_sums_of_any_longs_are_exact():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        x = rng.integers(-high, high, size=(5000, 3))
        assert (outer_sums(x) == x.astype(object).T.dot(x.astype(object))).all()
    values = [0, -1, 5, 2 ** 150 + 3, -(2 ** 170)]
    assert unpacked(packed(values)) == values
    assert unpacked([a + b for a, b in zip(packed(values), packed(values))]) == [2 * v for v in values]


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 12])
def test_polynomial_by_primes_equals_the_integer_recursion(spark, dim):
    m = scatter_matrix(np.random.default_rng(dim), 40, dim)
    assert characteristic_polynomial(spark, m) == plain_polynomial(m)


def test_polynomial_of_matrices_with_zero_pivots():
    p = primes_above(1)[0]
    for m in ([[0, 0, 1, 2], [0, 3, 0, 0], [1, 0, 0, 0], [2, 0, 0, 5]], [[2, 0], [0, 2]], [[0] * 3] * 3):
        m = np.array(m, dtype="int64")
        assert polynomial_mod(m, p) == [c % p for c in plain_polynomial(m.astype(object))]


def value(root):
    with localcontext() as context:
        context.prec = 100
        return Decimal(2 * root.at + 1) / 2 * Decimal(2) ** root.exponent


def test_roots_equal_eigenvalues_and_vectors_solve():
    m = scatter_matrix(np.random.default_rng(3), 60, 20)
    roots = greatest_roots(plain_polynomial(m), 8)
    want = np.linalg.eigvalsh(m.astype(float))[::-1]
    assert np.allclose([float(value(r)) for r in roots[:8]], want[:8], rtol=1e-12)
    top = int(np.trace(m)).bit_length()
    v = np.array([null_space(m, r, top)[0] for r in roots[:8]])
    assert np.abs(v @ v.T - np.eye(8)).max() < 1e-15
    assert np.abs(m.astype(float) @ v.T - v.T * want[:8]).max() < 1e-13 * want[0]


def test_repeated_near_and_zero_roots():
    m = np.diag([5, 5, 3, 3, 3, 2, 0, 0]).astype(object)
    assert [(round(value(r)), r.times) for r in greatest_roots(plain_polynomial(m), 6)] == [(5, 2), (3, 3), (2, 1)]
    space = np.array(null_space(m, greatest_roots(plain_polynomial(m), 6)[1], 5))
    assert np.abs(space @ space.T - np.eye(3)).max() < 1e-15 and np.abs(space[:, [0, 1, 5, 6, 7]]).max() < 1e-100
    near = np.diag([10 ** 30, 10 ** 30 - 1, 1]).astype(object)  # equal in doubles, apart here
    roots = greatest_roots(plain_polynomial(near), 3)
    assert [r.times for r in roots] == [1, 1, 1] and round(float(value(roots[0])) - float(value(roots[1]))) == 0
    with localcontext() as context:
        context.prec = 100
        assert round(value(roots[0]) - value(roots[1])) == 1
    assert np.abs(null_space(near, roots[0], 102)[0][1]) < 1e-20
    assert [round(value(r)) for r in greatest_roots(plain_polynomial(np.diag([4, 2, 1]).astype(object)), 8)] == [4, 2, 1]
    assert greatest_roots([1, 0, 0], 3) == []


def plain(rows, components=8):
    """The contract in plain integers and doubles: {vec_id: (deviation, whitened...)}, explained."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    n, dim = len(good), len(good[0][1])
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    s = [sum(r[d] for r in x) for d in range(dim)]
    z = [[n * r[d] - s[d] for d in range(dim)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n ** 3 for j in range(dim)] for i in range(dim)])
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    w = np.array(z, dtype=float) / n @ vec / np.sqrt(e)
    return n, {i: sum(c * c for c in r) for (i, _), r in zip(good, z)}, w, e / np.trace(cov), [i for i, _ in good]


def test_query_against_the_plain_version(spark, tmp_dir):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=10) * np.linspace(.2, 1, 10)]) for i in range(200)]
    bad = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] + [0.0] * 9), (903, [float("inf")] * 10), (904, []), (905, [1.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).withColumn("vector", F.lit(1))
    table.repartition(5).write.parquet(tmp_dir + "/embeddings.parquet")
    got = op12_whitening(spark, tmp_dir).collect()
    n, deviations, w, explained, ids = plain(rows)
    assert len(got) == n * 8 and {r["component"] for r in got} == set(range(1, 9))
    at = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]] == int(r["deviation_exact"])
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        signs.setdefault(c, np.sign(r["whitened"] * w[k, c]))
        assert abs(r["whitened"] - signs[c] * w[k, c]) < 1e-9


def test_edges(spark):
    def rows(vectors):
        return whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert rows([]) == [] and rows([None, []]) == [] and rows([[1.0, 2.0]]) == [] and rows([[1.0, 2.0]] * 5) == []
    got = rows([[1.0, 0.0], [-1.0, 0.0], [3.0, 0.0], [3.0, 0.0]])  # rank one, a repeated row
    assert len(got) == 4 and {r["component"] for r in got} == {1} and {r["explained"] for r in got} == {1.0}
    assert sum(r["whitened"] ** 2 for r in got) == pytest.approx(4) and got[0]["identity_error"] < 1e-12
    huge = rows([[1e300, 1.0], [-1e300, 2.0], [0.0, 5.0]])
    assert len(huge) == 6 and [r["vec_id"] for r in huge if r["deviation"] is None] == [0, 0, 1, 1] and huge[0]["identity_error"] < 1e-6
    # Values far from zero: products of uncentred doubles would lose the variance altogether.
    far = rows([[1e9 + i / 1024, float(i * i % 7)] for i in range(50)])
    assert far[0]["identity_error"] < 1e-9 and len(far) == 100
