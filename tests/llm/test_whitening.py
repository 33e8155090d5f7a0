import math

import numpy as np
import pytest

from quarry.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component int"


def run(spark, rows):
    return W.whiten(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)).collect()


def plain(rows):
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, (_, v) in enumerate(rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).T @ (fit - s / n) / n
    e, v = np.linalg.eigh(c)
    e, v = e[::-1], v[:, ::-1]
    return x, n, s, c, e, v


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)] + [(None, rows[5][1]), (7, rows[9][1])]
    got = run(spark, rows)
    x, n, s, c, e, v = plain(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    deviation = {tuple(a): sum((n * int(p) - int(t)) ** 2 for p, t in zip(a, s)) for a in x.values()}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation[tuple(a)] for a in x.values())
    for k in range(4):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        want = {rows[j][0]: (np.array(x[j]) - s / n) @ v[:, k] / math.sqrt(e[k]) for j in x}
        sign = math.copysign(1, mine[3] * want[3])
        assert all(abs(mine[i] - sign * w) < 1e-9 for i, w in want.items())
        assert all(abs(r.explained / (e[k] / np.trace(c)) - 1) < 1e-10 for r in got if r.component == k + 1)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i), float(i * i % 7)]) for i in range(9)]
    bad = [(20, None), (21, [1.0, None]), (22, [nan, 0.0]), (23, [0.0, -inf]), (24, []), (25, [1.0, 2.0, 3.0])]
    got = run(spark, good + bad)
    assert {r.vec_id for r in got} == {i for i, _ in good} and {r.component for r in got} == {1, 2}
    assert run(spark, bad[:5]) == [] and run(spark, []) == [] and run(spark, good[:1] * 3) == []
    flat = run(spark, [(i, [float(i), 2.0]) for i in range(3)])
    assert {r.component for r in flat} == {1} and sum(r.whitened for r in flat) == pytest.approx(0)


def test_negative_entries_are_floored(spark):
    got = run(spark, [(0, [-0.001]), (1, [0.001]), (2, [0.0])])
    assert sorted((r.vec_id, r.n, r.deviation) for r in got) == [(0, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(5)
    g = np.tril(rng.normal(size=(30, 30))) + 3 * np.eye(30)
    scale = np.diag(10.0 ** -np.arange(0, 30, 1) ** 0.8)
    a = scale @ g @ g.T @ scale  # graded: small eigenvalues are well determined
    e, v = W.jacobi(a)
    assert np.all(np.diff(e) <= 0) and np.abs(v.T @ v - np.eye(30)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-13 * e[0]
    # The small ones to relative precision: the inverse's large ones.
    inverse = np.linalg.inv(scale) @ np.linalg.inv(g @ g.T) @ np.linalg.inv(scale)
    f, _ = W.jacobi(inverse)
    assert np.allclose(1 / f[::-1], e, rtol=1e-9)


def test_large_deviations_are_exact():
    x, total = np.array([[10**9, 3]]), np.array([1, 2])
    assert W.deviations(x, 3, total).tolist() == [(3 * 10**9 - 1) ** 2 + 49]
    with pytest.raises(OverflowError):
        W.deviations(np.array([[1 << 40]]), 1 << 20, np.array([0]))
