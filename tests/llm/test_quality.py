import random
import zlib

import numpy as np
from helpers import LABELS, clashing, docs, prose

from matchbook.llm import quality as q


def corpus(spark, n=500):
    rows, labels = [], []
    for i in range(n):
        r, good = random.Random(i), i % 3 > 0
        text = prose(i, r.randrange(20, 200)).capitalize() + "."
        if not good:
            text = " ".join([r.choice(("Buy", "now", "ab***"))] * 60) if i % 2 else text.replace(" ", "!! ").upper()
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS)


def train(table, labels):
    return q.train(q.measure(table), labels)


def test_held_out_accuracy_and_cases(spark):
    table, labels = corpus(spark)
    extra = docs(spark, [(9001, None), (9002, ""), (None, "x"), (9003, prose(3, 40_000)), (9004, " \n "), (9004, " \n ")])
    table = clashing(table.unionByName(extra), "score", "quality", "row", "sums")
    model = train(table, labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0), (7, 0, 0)], LABELS)))
    out = q.score(q.measure(table), model).select("doc_id", "score").collect()
    assert len(out) == 506 and all(0 <= r["score"] <= 1 for r in out)
    held = [(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in out
            if r["doc_id"] is not None and r["doc_id"] < 500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert len({r["score"] for r in out if r["doc_id"] in (9001, 9002, 9004)}) == 1


def test_partition_sums_do_not_depend_on_partitions(spark):
    table, labels = corpus(spark, 200)
    a, b = train(table.repartition(1), labels), train(table.repartition(6), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.levels, b.levels)


def test_normal_equations_against_numpy(spark):
    table, labels = corpus(spark, 200)
    model = train(table, labels)
    use = [(r["text"], r["quality"]) for r in table.join(labels, "doc_id").collect()
           if zlib.crc32(str(r["doc_id"]).encode()) % 5 > 1]
    z = model.kernel(np.array([q.statistics(t.encode()) for t, _ in use]))
    y = np.array([v for _, v in use], dtype=float)
    k = z.shape[1]
    want = np.linalg.solve(z.T @ z + q.RIDGE * len(y) / k * np.eye(k), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    kernel = q.Kernel(np.zeros(6), np.ones(6), n=20_000)
    x = rng.normal(size=(20, 6))
    z = kernel(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * q.BANDWIDTH ** 2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = rng.integers(0, 4, 12).astype(float)
        p = np.minimum(n, rng.integers(0, 4, 12))
        got = q.isotonic(n, p)
        assert (np.diff(got) >= -1e-12).all()
        full = np.flatnonzero(n)
        # min-max formula of the isotonic regression
        want = [max(min(p[a:b + 1].sum() / n[a:b + 1].sum() for b in full if b >= i) for a in full if a <= i) for i in full]
        assert np.allclose(got[full], want)


def test_without_labels_and_empty(spark):
    table, labels = corpus(spark, 10)
    assert train(table, labels.limit(0)) is None
    assert {r["score"] for r in q.score(q.measure(table), None).collect()} == {0.5}
    assert q.score(q.measure(table.limit(0)), train(table, labels)).count() == 0
