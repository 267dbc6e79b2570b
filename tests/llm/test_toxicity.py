import zlib

import numpy as np
from helpers import LABELS, clashing, docs, prose

from matchbook.llm import toxicity as t

INSULTS = ["scum", "moron", "trash", "clown"]


def crc5(i):
    return zlib.crc32(str(i).encode()) % 5


def corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(i, 40).split()
        if toxic:
            words[5] = INSULTS[i // 4 % 4]
            words[20] = INSULTS[(i // 4 + 1) % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_cases(spark):
    table, labels = corpus(spark)
    extra = docs(spark, [(9001, None), (9002, ""), (None, "you moron and scum"), (9003, "moron scum " + prose(1, 30_000)),
                         (9004, "w1"), (9004, "w1")])
    more = spark.createDataFrame([(1, 1, None), (0, 0, 0), (None, 1, 1), (9999, 1, 1)], LABELS)
    table = clashing(table.unionByName(extra), "score", "toxic", "features", "label")
    model = t.train(table, labels.unionByName(more))
    out = t.score(table, model).select("doc_id", "text", "score").collect()
    assert len(out) == 606 and all(0 <= r["score"] <= 1 for r in out)
    held = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in out
            if r["doc_id"] is not None and r["doc_id"] < 600 and crc5(r["doc_id"]) == 0]
    assert len(held) > 80 and np.mean(held) > 0.97
    by_text = {}
    for r in out:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""] and max(by_text["you moron and scum"]) > 0.5
    assert next(r["score"] for r in out if r["doc_id"] == 9003) > 0.5


def test_margin_equals_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = t.FactorizationMachine(np.arange(0, 60, 3, dtype=np.int32))
    m.bias, m.weights, m.factors = 0.3, rng.normal(size=20), rng.normal(size=(20, 4))
    feats = np.array([0, 1, 3, 9, 30, 57, 58], dtype=np.int32)                 # 1 and 58 are unknown
    at = [0, 1, 3, 10, 19]
    want = 0.3 + m.weights[at].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[i + 1:])
    assert abs(m.margin(feats) - want) < 1e-9


def test_texts_scored_together_score_as_alone(monkeypatch):
    texts = [prose(i, 5 + 40 * (i % 4)).encode() for i in range(30)] + [None, b"", b"w1 w1 w1", prose(3, 125).encode()]
    known = np.unique(np.concatenate([t.features(x, {}) for x in texts[:10]]))
    rng = np.random.default_rng(4)
    m = t.FactorizationMachine(known)
    m.bias, m.weights, m.factors = -0.2, rng.normal(size=len(known)), rng.normal(size=(len(known), 4))
    want = [1 / (1 + np.exp(-np.clip(m.margin(t.features(x, {})), -30, 30))) for x in texts]
    for lot in (1, 50, 1 << 20):
        monkeypatch.setattr(t, "LOT", lot)
        assert list(m.scores(texts, {})) == want
    monkeypatch.setattr(t, "CACHE", 3)
    assert list(m.scores(texts, {})) == want
    assert len(m.scores([], {})) == 0 and len(set(m.scores([texts[3], texts[3]], {}))) == 1


def test_learns_an_interaction_that_weights_cannot():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([f for f, on in ((1, a), (2, b), (3 + rng.integers(5), 1)) if on], dtype=np.int32))
        y.append(float(a and b) if rng.random() > 0.02 else float(not (a and b)))
    m = t.FactorizationMachine(np.arange(1, 8, dtype=np.int32))
    m.fit(rows, np.array(y), epochs=60)
    both, one, other = (m.margin(np.array(f, dtype=np.int32)) for f in ([1, 2], [1], [2]))
    assert both > 0 > max(one, other) and m.factors[0] @ m.factors[1] > 0.5


def test_missing_classes_and_empty_tables(spark):
    table, labels = corpus(spark, 12)
    assert t.train(table, labels.filter("toxic = 1")) == 1.0
    assert t.train(table, labels.limit(0)) == 0.0 and t.train(table.limit(0), labels) == 0.0
    assert t.score(table, 0.0).filter("score = 0").count() == 12
    assert t.score(table.limit(0), t.FactorizationMachine(np.zeros(0, np.int32))).count() == 0


def test_sample_is_bounded_and_seeded(spark):
    table, labels = corpus(spark)
    a, b = t.train(table, labels, max_rows=100), t.train(table.repartition(5), labels, max_rows=100)
    assert np.allclose(a.weights, b.weights) and list(a.known) == list(b.known)
