import math
from collections import Counter

import numpy as np
from helpers import clashing, docs, prose
from pyspark.sql import functions as F

from matchbook.llm import lexical_search as s
from matchbook.llm.decontaminate import words_of

ITEMS = "item_id long, text string"


def brute(rows, items, top=50):
    """Rows (item_id, rank, doc_id, score) by scoring every document."""
    table = [(i, Counter(words_of((t or "").encode()))) for i, t in rows]
    table = [(i, c) for i, c in table if c]
    n_docs, total = len(table), sum(sum(c.values()) for _, c in table)
    df = Counter(w for _, c in table for w in c)
    out = []
    for item, text in items:
        terms = set(words_of((text or "").encode()))
        scored = []
        for i, c in table:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) *
                        ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -sc) for r, (sc, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def got(spark, rows, items, **kw):
    found = s.rank(docs(spark, rows).repartition(3), spark.createDataFrame(items, ITEMS), **kw)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def corpus(n=300, words=120):
    rows = [(i, prose(i, 3 + i * 7 % 90, words)) for i in range(n)]
    rows += [(n + i, prose(4, 30, words)) for i in range(70)]                    # more ties than places
    return rows


def test_equals_scoring_every_document(spark):
    items = [(i, prose(1000 + i, 4 + i * 3, 150)) for i in range(12)] + [(50, "w1"), (51, "w1 w1 W1, w2!"), (52, prose(4, 30, 120))]
    assert got(spark, corpus(), items) == brute(corpus(), items)
    assert got(spark, corpus(), items, top=3) == brute(corpus(), items, top=3)


def test_segments_and_blocks_change_nothing(spark, monkeypatch):
    items = [(i, prose(1000 + i, 20, 150)) for i in range(9)]
    want = brute(corpus(), items)
    monkeypatch.setattr(s, "SEGMENT_DOCS", 37)
    monkeypatch.setattr(s, "FIRST_STEP", 1)
    assert got(spark, corpus(), items) == want
    assert got(spark, corpus(), items, block_bytes=200) == want


def test_defined_cases(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "... - "), (4, "Straße ÄB alpha"), (None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"),
            (6, long), (7, "beta Alpha_alpha"), (8, "gamma")]
    items = [(1, "ALPHA beta"), (1, "gamma"), (2, None), (3, ""), (4, "nowhere at all"), (None, "straße Äb"), (5, "w7 w8 alpha")]
    assert got(spark, rows, items) == brute(rows, items)
    table, asked = docs(spark, rows), spark.createDataFrame(items, ITEMS)
    assert s.rank(table.limit(0), asked).count() == 0 and s.rank(table, asked.limit(0)).count() == 0
    assert s.rank(table.filter("doc_id < 4"), asked).count() == 0
    names = ("score", "rank", "item", "item_id", "terms", "n", "tie", "row", "size")
    other = s.rank(clashing(table, *names), clashing(asked, *[n for n in names if n != "item_id"], "doc_id"))
    assert sorted((tuple(r) for r in other.collect()), key=repr) == brute(rows, items)


def segment(seed, n_docs, n_terms, most):
    rng = np.random.default_rng(seed)
    have = rng.random((n_terms, n_docs)) < rng.random((n_terms, 1))
    term, doc = np.nonzero(have)
    impact = rng.integers(1, most, len(term))
    scores = np.zeros(n_docs, dtype=np.int64)
    np.add.at(scores, doc, impact)
    return s.Segment(doc, term, impact, n_docs, n_terms), scores


def test_nra_keeps_every_tie_and_exact_scores(monkeypatch):
    monkeypatch.setattr(s, "FIRST_STEP", 1)
    for seed in range(60):
        seg, scores = segment(seed, 40 + seed, 1 + seed % 7, 4 if seed % 2 else 1000)
        k, terms = 1 + seed % 9, np.arange(1 + seed % 7)
        floor = 1 if seed % 3 else int(np.sort(scores)[-1])
        at, best = seg.top(terms, k, floor)
        least = max(floor, int(np.sort(scores)[-k]))
        assert sorted(zip(at.tolist(), best.tolist(), strict=True)) == [
            (i, int(v)) for i, v in enumerate(scores.tolist()) if v >= least and v > 0]


def test_documents_that_cannot_win_are_left_before_the_lists_end():
    """Only the heads of the lists are high: the rest changes no interval."""
    n = 100_000
    docs_ = np.concatenate([np.arange(n), np.arange(n)])
    terms = np.repeat([0, 1], n)
    high = np.where(np.arange(n) < 60, 1_000_000 - np.arange(n), 1)
    seg = s.Segment(docs_, terms, np.concatenate([high, high]), n, 2)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return super().__getitem__(key)
    seg.docs = seg.docs.view(Counted)
    at, best = seg.top(np.array([0, 1]), 50)
    assert at.tolist() == list(range(50)) and (np.asarray(best) == 2 * high[:50]).all()
    assert sum(reads) < 1000


def test_counts_and_weights():
    assert s.term_counts("The the, THE x1 É".encode(), {b"the": 0, "É".encode(): 1}) == (5, [0, 1], [3, 1])
    assert s.term_counts(None, {b"a": 0}) == (0, [], [])
    assert s.weight(10, 0) == math.floor(1000 * math.log(22)) and s.weight(1000, 1000) == 0


def test_every_row_of_a_hot_id_is_a_document(spark):
    rows = [(9, prose(i, 20, 50)) for i in range(120)]
    found = got(spark, rows, [(1, "w1 w2 w3")])
    assert found == brute(rows, [(1, "w1 w2 w3")]) and len(found) > 10
    table = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("w1").alias("text"))
    assert s.rank(table, spark.createDataFrame([(1, "w1")], ITEMS)).count() == 0       # weight 0: no score above 0
