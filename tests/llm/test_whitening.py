import math

import numpy as np
import pytest
from graftline.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(n, S, x by id, eigenvalues, eigenvectors, trace) by the library's own eigensolver."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    return n, sums, x, e[::-1], v[:, ::-1], float(np.trace(cov))


def held_against(rows, found, components=16):
    n, sums, x, e, v, trace = brute(rows)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(x)
    k = min(components, len(sums))
    white = []
    for i, parts in got.items():
        assert sorted(parts) == list(range(1, k + 1))
        off = [n * a - s for a, s in zip(x[i], sums, strict=True)]
        assert {r.deviation for r in parts.values()} == {sum(o * o for o in off)}
        assert {r.n for r in parts.values()} == {n}
        want = np.array([o / n for o in off]) @ v[:, :k] / np.sqrt(e[:k])
        white.append(([parts[c + 1].whitened for c in range(k)], want))
        for c in range(k):
            assert math.isclose(parts[c + 1].explained, e[c] / trace, rel_tol=1e-9)
    own, want = (np.array(c) for c in zip(*white, strict=True))
    sign = np.sign((own * want).sum(axis=0))
    assert np.allclose(own * sign, want, rtol=0, atol=1e-7)
    assert {r.identity_error for r in found}.pop() < 1e-9 and len({r.identity_error for r in found}) == 1


@pytest.mark.parametrize("d", [1, 2, 7, 33])
def test_jacobi_equals_eigh(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 3 * d))
    a = a @ a.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(vectors * values @ vectors.T, a, atol=1e-11 * np.abs(a).max())


def test_small_eigenvalues_are_relatively_accurate():
    """A graded matrix: eigenvalues from 1 to 1e-24, each found to many digits, where eigh keeps only absolute precision."""
    scales = 10.0 ** -np.arange(0, 13, 2)
    base = np.eye(7) + 0.1 * np.ones((7, 7))
    graded = base * np.outer(scales, scales)
    values, _ = whitening.jacobi(graded)
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in graded]
    det = Fraction(1)
    for i in range(7):  # exact elimination: the product of all eigenvalues
        det *= exact[i][i]
        for r in range(i + 1, 7):
            f = exact[r][i] / exact[i][i]
            exact[r] = [p - f * q for p, q in zip(exact[r], exact[i], strict=True)]
    assert (values > 0).all()
    assert math.isclose(math.prod(values.tolist()), float(det), rel_tol=1e-12)


def test_degenerate_matrices():
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.jacobi(np.zeros((0, 0)))[0].tolist() == []
    assert whitening.jacobi(np.ones((2, 2)))[0] == pytest.approx([2, 0])


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    bad = [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [float("inf")]), (2003, [1.0] * 19 + [None])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id long, embedding array<float>, x string").repartition(4)
    held_against(rows + bad, whitening.whiten(df).collect())
    short = whitening.whiten(df, components=3).collect()
    held_against(rows, short, 3)


def test_lengths_empty_vectors_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0]), (None, [3.0, 5.5]), (4, [1.0]), (5, [])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.component) for r in got) == [(False, 1)] * 2 + [(False, 2)] * 2 + [(True, 1), (True, 2)]
    assert whitening.whiten(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(0, 0.0, 0.0, 0.0)}


def test_wide_numbers_stay_exact(spark):
    rows = [(1, [1e13, 0.0]), (2, [0.0, 1.0]), (3, [5.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, sums, x, *_ = brute(rows)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    assert {r.vec_id: r.deviation for r in whitening.whiten(df).collect()} == {i: s if s < 2**63 else None for i, s in want.items()}


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, SF)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held_against(rows, got.collect())
