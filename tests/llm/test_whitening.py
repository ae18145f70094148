import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import whitening
from tests.llm.conftest import EXTRA, SF


def plain(rows, k=16):
    """{(id, component): (n, deviation, |whitened|, explained)} by a dense eigenvalue solver."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in rows)
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v) + (1_000_000,) * (dims - len(v))) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    out = []
    for i, x in xs:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vector / np.sqrt(value)
        out += [(i, j + 1, n, deviation, z[j], value[j] / np.trace(covariance)) for j in range(len(value))]
    return out


def signed(rows):
    """Whitened values up to one sign a component, so that their list is comparable."""
    sign = {}
    for row in sorted(rows, key=lambda r: (r[1], -abs(r[4]), r[3])):
        sign.setdefault(row[1], math.copysign(1, row[4]))
    return sorted([(*r[:4], r[4] * sign[r[1]], r[5]) for r in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def check(frame, rows):
    got = frame.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    want = signed(plain(rows))
    assert [tuple(r[:4]) for r in signed([(*r[:3], int(r[3]), *r[4:6]) for r in got])] == [r[:4] for r in want]
    for a, b in zip(signed([(*r[:3], int(r[3]), *r[4:6]) for r in got]), want):
        assert a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], rel=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(whitening.op11_whitening(spark, SF), rows)


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in draw.normal(size=5) * [5, 3, 2, 1, 0.5]]) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (70, rows[6][1][:3]), (71, [9.0, -7.5, 0.0, 1e3, -0.0])]
    bad = [(80, None), (81, []), (82, [1.0, None, 2.0]), (83, [float("nan")] * 5), (84, [float("inf")] * 5)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in [*EXTRA, "x", "z", "vector", "deviation"]])
    check(whitening.whiten(frame), rows)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id = 3")).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(frame.filter("vec_id >= 80")).count() == 0


def test_directions_without_variance_are_no_components(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, float(i % 3), 4.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 80
    assert got[0].identity_error < 1e-9 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)


@pytest.mark.parametrize("dims, ratio", [(200, 0.97), (300, 0.999), (120, 1.0)])
def test_pairs_of_larger_matrices(dims, ratio):
    """Falling, close and equal eigenvalues; the subspace restarts and never holds all dimensions."""
    draw = np.random.default_rng(dims)
    turn = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
    value = ratio ** np.arange(dims)
    matrix = (turn * value) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vector = whitening.leading_pairs(lambda y: matrix @ y, dims, 16)
    assert np.allclose(found, value[:16], rtol=1e-12)
    assert np.linalg.norm(matrix @ vector - vector * found, axis=0).max() < 1e-12
    assert np.abs(vector.T @ vector - np.eye(16)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(3)
    matrix = draw.normal(size=(40, 40))
    matrix = matrix + matrix.T
    right = draw.normal(size=(40, 3))
    found = whitening.minres(lambda y: matrix @ y, right, 200, 1e-10)
    assert np.allclose(matrix @ found, right, atol=1e-6)
