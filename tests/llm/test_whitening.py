import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from matchbook.llm import whitening as w

ROWS = "vec_id long, embedding array<float>"


def brute(vectors, top=16):
    x = {tuple(int(np.floor(64 * float(c))) + 1000000 for c in v) for v in vectors}
    fit = sorted(x)
    n, d = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(d)]
    y = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in fit])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return n, sums, e[::-1][:top], u[:, ::-1][:, :top], np.trace(cov)


def check(spark, data, top=16):
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(data)], ROWS)
    stored = {r["vec_id"]: r["embedding"] for r in table.collect()}
    n, sums, e, u, trace = brute(stored.values(), top)
    out = w.whiten(table, w.fit(table, top=top)).select("vec_id", F.inline("whitening")).collect()
    k = min(top, len(sums))
    assert len(out) == len(data) * k
    signs = {}
    for r in out:
        c = r["component"] - 1
        x = [int(np.floor(64 * v)) + 1000000 for v in stored[r["vec_id"]]]
        off = [n * a - s for a, s in zip(x, sums)]
        assert r["n"] == n and r["deviation"] == sum(o * o for o in off)
        assert abs(r["explained"] - e[c] / trace) <= 1e-9 * max(1e-9, e[c] / trace) + 1e-13
        assert r["identity_error"] < 1e-9
        want = float(np.array(off) / n @ u[:, c] / np.sqrt(e[c]))
        if abs(want) > 1e-6:
            signs.setdefault(c, np.sign(want) == np.sign(r["whitened"]))
            assert (np.sign(want) == np.sign(r["whitened"])) == signs[c]
            assert abs(abs(want) - abs(r["whitened"])) < 1e-8 * max(1, abs(want))
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.5, 20)
    data = np.vstack([base, base[:50], base[:1].repeat(200, axis=0)])             # copies count once in the fit
    out = check(spark, data)
    assert {r["component"] for r in out} == set(range(1, 17))
    first = [r["whitened"] for r in out if r["vec_id"] == 0]
    assert first == [r["whitened"] for r in out if r["vec_id"] == 549]


def test_few_dimensions_and_far_means(spark):
    rng = np.random.default_rng(4)
    check(spark, 5000 + rng.normal(size=(80, 3)), top=16)
    check(spark, rng.normal(size=(40, 1)) * 10)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(7, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [nan, 0.0, 0.0, 0.0]), (104, [inf, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0])]
    table = clashing(spark.createDataFrame(good + bad, ROWS), "whitening", "component", "n", "x", "_x")
    out = w.whiten(table, w.fit(table))
    rows = out.select("vec_id", F.inline("whitening").alias("a", "b", "c", "d", "e", "f")).collect()
    assert len(rows) == 32 * 4 and {r["vec_id"] for r in rows if r["vec_id"] is None or r["vec_id"] < 100} == \
        {g[0] for g in good} and max(r["vec_id"] or 0 for r in rows) < 100
    huge = spark.createDataFrame([(i, [float(i), 1e30 * (-1) ** i, 0.0]) for i in range(9)], ROWS)
    got = w.whiten(huge, w.fit(huge)).select(F.inline("whitening")).collect()
    assert len(got) == 27 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
    empty = table.limit(0)
    assert w.fit(empty) is None and w.whiten(empty, None).count() == 0


def test_components_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0]), (3, [1.0, 2.0, 3.0])], ROWS)
    rows = w.whiten(table, w.fit(table)).select("vec_id", F.inline("whitening")).collect()
    white = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    assert abs(abs(white[1, 1]) - 1) < 1e-12 and white[1, 1] == white[3, 1] == -white[2, 1]
    assert white[1, 2] is None and white[1, 3] is None and rows[0]["identity_error"] < 1e-12
    one = spark.createDataFrame([(1, [1.0, 2.0])], ROWS)
    rows = w.whiten(one, w.fit(one)).select(F.inline("whitening")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows] == [(1, 0, None, 0, 0)] * 2


def spectrum(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("matrix", [
    spectrum(np.linspace(50, 1, 64), 1), spectrum([9.0] * 20 + [1.0] * 30, 2), spectrum([5, 5, 5 - 1e-13, 2, 2, 1e-9, 0, 0], 3),
    np.diag([3.0, 1, 2, 2, 5]), np.eye(6) * 4, np.zeros((3, 3)), np.array([[2.0]]), np.array([[1.0, 1.0], [1.0, 1.0]]),
    spectrum(np.logspace(0, -14, 40), 4), spectrum(np.linspace(1, 2, 30), 5) * 1e200, spectrum(np.linspace(1, 2, 30), 5) * 1e-200])
def test_eigenpairs(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = w.leading_components(matrix, 16)
    want = np.maximum(np.linalg.eigvalsh(matrix)[::-1][:16], 0)
    norm = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * norm * len(matrix)
    k = len(values)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(vectors @ (matrix / norm) - (values / norm)[:, None] * vectors).max() < 1e-12
    assert k == min(16, len(matrix))


def test_sturm_counts():
    rng = np.random.default_rng(6)
    diag, off = rng.normal(size=30), rng.normal(size=29)
    off[7] = 0
    e = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.normal(size=50) * 2
    assert (w.counts_below(diag, off, at) == [(e < a).sum() for a in at]).all()
