"""Hot keys: one key holds more than a third of the rows.  Results must equal
brute force, and the plans must reduce the hot key before any shuffle
(partial aggregation) instead of sending it whole to one task."""

import random
from collections import defaultdict

import numpy as np

from matchbook.operators.embedding import elementwise_mean
from matchbook.operators.identity import latest_per_key
from matchbook.operators.profile import skill_share
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.textfilter import keyword_matches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_key(rnd, hot_share=0.4, n_cold=30):
    return "hot" if rnd.random() < hot_share else f"k{rnd.randrange(n_cold)}"


def test_elementwise_mean_hot_group(spark):
    rnd = random.Random(1)
    rows = [(_hot_key(rnd), [rnd.uniform(-1, 1) for _ in range(4)]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, vec array<double>").repartition(8)
    out = elementwise_mean(df, "g", "vec", dim=4)
    assert "partial_avg" in plan(out)
    got = {r.g: (r.vec, r.n_vectors) for r in out.collect()}
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][1] == len(vs)
        assert np.allclose(got[g][0], np.mean(vs, axis=0), atol=1e-12)


def test_skill_share_hot_profile(spark):
    rnd = random.Random(2)
    rows = [(i, _hot_key(rnd), float(rnd.randrange(1, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, profile string, w double").repartition(8)
    out = skill_share(df, "profile", "w")
    assert "Window" not in plan(out)                  # totals are aggregated, not windowed
    assert "partial_sum" in plan(out)
    totals = defaultdict(float)
    for _, p, w in rows:
        totals[p] += w
    got = {r.id: r.share_pct for r in out.collect()}
    assert len(got) == len(rows)
    for i, p, w in rows:
        assert abs(got[i] - 100.0 * w / totals[p]) < 1e-9


def test_top_n_hot_user(spark):
    rnd = random.Random(3)
    rows = [(_hot_key(rnd), f"j{i:05d}", float(rnd.randrange(100))) for i in range(4000)]
    df = spark.createDataFrame(rows, "u string, j string, s double").repartition(8)
    out = top_n_per_group(df, "u", "s", 7, "j")
    assert "WindowGroupLimit" in out._jdf.queryExecution().sparkPlan().toString()
    want = {}
    by_user = defaultdict(list)
    for u, j, s in rows:
        by_user[u].append((-s, j))
    for u, items in by_user.items():
        for rank, (neg, j) in enumerate(sorted(items)[:7], 1):
            want[(u, rank)] = j
    got = {(r.u, r.rank): r.j for r in out.collect()}
    assert got == want


def test_latest_per_key_hot_key(spark):
    rnd = random.Random(4)
    rows = [(_hot_key(rnd), i, rnd.randrange(10**6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, ts long").repartition(8)
    out = latest_per_key(df, "k", ["ts", "id"])
    assert "partial_max_by" in plan(out)
    want = {}
    for k, i, ts in rows:
        if k not in want or (ts, i) > (want[k][1], want[k][0]):
            want[k] = (i, ts)
    assert {r.k: (r.id, r.ts) for r in out.collect()} == want


def test_keyword_filter_hot_term(spark):
    # one term appears in nearly every document; users include or exclude it
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    docs = []
    for d in range(600):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(3, 12))]
        if rnd.random() < 0.9:
            words.append("common")
        docs.append((d, " ".join(words)))
    kw = [(1, "common", "w1"), (2, "w2 w3", "common"), (3, "w4 common", "w5 w6")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    kdf = spark.createDataFrame(kw, "user_id long, what_or string, what_exclude string")
    for limit, inline in ((5_000_000, 256), (0, 256), (5_000_000, 0), (0, 0)):
        # broadcast or shuffled term join; vocabulary inlined or not
        got = {(r.user_id, r.doc_id)
               for r in keyword_matches(ddf, kdf, max_broadcast_terms=limit,
                                        inline_max_terms=inline).collect()}
        want = set()
        for d, text in docs:
            toks = set(text.split())
            for u, inc, exc in kw:
                if toks & set(inc.split()) and not toks & set(exc.split()):
                    want.add((u, d))
        assert got == want


def test_keyword_pairs_are_made_once_in_cells_and_never_shuffled(spark):
    from matchbook.operators.textfilter import pairs_of_hits
    rnd = random.Random(8)
    held = {d: {f"w{rnd.randrange(12)}" for _ in range(4)} | {"common"} for d in range(80)}
    hits = [(d, t) for d, ts in held.items() for t in sorted(ts)] + [(3, "common"), (None, "w1"), (None, "w2")]
    users = {u: ({f"w{rnd.randrange(12)}" for _ in range(3)} | {"common"}, {f"w{rnd.randrange(14)}"}) for u in range(30)}
    terms = [(u, t, bad) for u, sides in users.items() for bad, ts in enumerate(sides) for t in sorted(ts)]
    hdf = spark.createDataFrame(hits, "doc_id long, term string").repartition(4)
    tdf = spark.createDataFrame([(u, t, bool(bad)) for u, t, bad in terms], "user_id long, term string, is_exclude boolean")
    want = sorted([(u, d) for d, ts in held.items() for u, (inc, exc) in users.items() if ts & inc and not ts & exc]
                  + [(u, -1) for u, (inc, _) in users.items() if inc & {"w1", "w2"}])
    for cell in (1, 50, 4_000_000):
        pairs = pairs_of_hits(hits=hdf, terms=tdf, doc_key="doc_id", cell_pairs=cell)
        assert sorted((r.user_id, -1 if r.doc_id is None else r.doc_id) for r in pairs.collect()) == want
        # from the join that makes the pairs to the result: no exchange, aggregate or further join
        plan = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert plan[1].lstrip("+- ").startswith("Join Inner") and plan[0].startswith("Project")
