import math

import numpy as np
from pyspark.sql import functions as F

from matchbook.functions.vectors import cosine, unit
from matchbook.operators.embedding import elementwise_mean, ref_readiness


def test_cosine_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for i in range(50)]
    rows += [(99, [0.0] * 8, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    scaled = df.select("id", cosine("a", "b").alias("c"),
                       cosine(F.transform("a", lambda x: x * 7.5), "b").alias("c2")).collect()
    for r in scaled:
        if r.id == 99:
            assert r.c is None                  # zero vector: NULL, not NaN, no error
            continue
        a, b = rows[r.id][1], rows[r.id][2]
        ref = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
        assert -1 - 1e-12 <= r.c <= 1 + 1e-12
        assert math.isclose(r.c, ref, abs_tol=1e-12)
        assert math.isclose(r.c, r.c2, abs_tol=1e-12)   # scale invariant


def test_unit_and_mismatched_lengths(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(unit("a").alias("u"), cosine("a", "b").alias("c")).first()
    assert r.u == [0.6, 0.8]
    assert r.c is None


def test_elementwise_mean_and_mixed_dims(spark):
    rows = [("u", [1.0, 2.0]), ("u", [3.0, 6.0]), ("v", [1.0, 1.0]), ("v", [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, vec array<double>")
    got = {r.g: (r.vec, r.n_vectors) for r in elementwise_mean(df, "g", "vec", dim=2).collect()}
    assert got["u"] == ([2.0, 4.0], 2)
    assert got["v"][0] is None                  # inconsistent lengths are not averaged


def test_readiness(spark):
    rows = [("a", f, l, [1.0]) for f in ("description", "title") for l in ("FR", "EN")]
    rows += [("b", "title", "FR", [1.0]), ("b", "title", "EN", None)]
    df = spark.createDataFrame(rows, "user_id string, field string, lang string, vec array<double>")
    got = {r.user_id: r.ready for r in ref_readiness(df).collect()}
    assert got == {"a": True, "b": False}
