"""Whitening against numpy, exact whole-number arithmetic and odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from splicewell.llm import whitening

SF = "/root/testdata/sf0.001"


def force(vectors):
    """n, sums, deviations and falling eigenvalues of the vectors, with whole numbers of any size."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(a * n - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    return n, sums, far, centred, np.linalg.eigvalsh(centred.T @ centred / n)[::-1]


@pytest.mark.parametrize("size", [1, 2, 3, 8, 33])
def test_jacobi_against_numpy(size):
    rng = np.random.default_rng(size)
    for scale in (1.0, 1e-9):
        b = rng.normal(size=(size, size)) * np.logspace(0, -5, size) * scale
        a = b.T @ b
        values, vectors = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-15 * values[0])
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, a, atol=1e-12 * values[0])


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix, whose least eigenvalue is 1e-20 of its largest, keeps its digits."""
    scale = np.diag(10.0 ** -np.arange(0, 11, 2))
    core = np.eye(6) + 0.1 * np.ones((6, 6))
    values, _ = whitening.jacobi(scale @ core @ scale)
    assert math.isclose(np.prod(values), np.linalg.det(core) * 10.0**-60, rel_tol=1e-10)
    for a in (np.zeros((3, 3)), np.diag([2.0, 2.0, 5.0])):
        assert whitening.jacobi(a)[0].tolist() == sorted(np.diag(a), reverse=True)


def test_op11_against_force(spark):
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    kept = [(i, v) for i, v in table if v and all(c is not None and math.isfinite(c) for c in v)]
    n, _, far, centred, values = force([v for _, v in kept])
    rows = whitening.op11_whitening(spark, SF).collect()
    assert len(rows) == 32 * len(kept)
    at = {i: k for k, (i, _) in enumerate(kept)}
    white = np.zeros((n, 32))
    for r in rows:
        assert r["n"] == n and r["deviation"] == far[at[r["vec_id"]]] and r["identity_error"] <= 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-9)
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9
    vectors = np.linalg.eigh(centred.T @ centred / n)[1][:, ::-1][:, :32]
    wanted = centred @ vectors / np.sqrt(values[:32])
    assert np.allclose(np.abs(white), np.abs(wanted), atol=1e-6)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], "x"), (1, [1.0, 0.0, 0.0], "x"), (2, [0.0, 2.0, 0.0], None), (None, [0.5, -1.0, 0.0], "x"), (4, None, "x"), (5, [], "x"),
        (6, [1.0, None, 0.0], "x"), (7, [float("nan"), 0.0, 0.0], "x"), (8, [float("inf"), 0.0, 0.0], "x"), (9, [1.0, 1.0], "x"), (10, [1e300, 0.0, 0.0], "x"),
        (11, [-1e5, 0.25, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, whitened string")
    model = whitening.fit(df, "v")
    good = [rows[i][1] for i in (0, 1, 2, 3, 11)]
    n, sums, far, _, values = force(good)
    assert (model.n, model.sums, model.dimensions) == (n, sums, 3)
    found = whitening.whiten(df, model, "v", into="w", deviation="d")
    assert found.columns == ["vec_id", "v", "whitened", "w", "d"]
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["d"], r["w"][2], r["whitened"]) for r in found.collect())
    assert [g[1] for g in got] == [far[0], far[1], far[2], far[4], far[3]]
    assert all(g[2] is None for g in got)  # the third dimension never varies
    assert got[2][3] is None
    assert whitening.identity_error(found, model, "w") < 1e-9


def test_deviations_beyond_longs():
    x = np.array([[2**50, -3], [-(2**50), 5], [7, 7]])
    sums = [int(s) + 3 * whitening.SHIFT for s in x.sum(axis=0)]
    full = [sum((3 * (a + whitening.SHIFT) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening._deviations(x, sums, 3) == [v if v < 2**63 else None for v in full]
    assert full[2] < 2**63 <= full[0]


def test_no_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.fit(df) is None
    assert whitening.whiten(df, None).collect() == []
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op11_whitening(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
