import itertools

import numpy as np
from fractions import Fraction

from helpers import WORD, clashing, docs, prose

from matchbook.llm.mixing import WEIGHTS, fit_counts, knapsack, mix


def targets(sizes):
    """Water filling by hand: {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(3 * sum(sizes.values()), 2), set(names), {}
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * per >= 2 * sizes[s]}
        if not over:
            out |= {s: weight[s] * per for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_targets_takes_and_reruns(spark):
    rows = [(i, prose(i, 5 + i * 7 % 61), f"s{i % 4}") for i in range(160)]
    rows += [(1000 + i, prose(i, 50), None) for i in range(5)] + [(2000, None, "s0"), (2001, "", "s1"), (None, "a b", "s2")]
    rows += [(5, prose(5, 9), "hot")] * 120
    table = clashing(docs(spark, rows), "size", "target", "rank", "bucket", "total")
    got = [tuple(r) for r in mix(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in mix(table.repartition(7)).collect())))
    sizes, by_id = {}, {}
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[2]] = sizes.get(r[2], 0) + n
        by_id.setdefault((r[0], n), []).append(r[2])
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for ident, size, source_size, target, words in got:
        source = next(s for s in by_id[ident, size] if sizes[s] == source_size)
        assert abs(target - float(want[source])) < 1e-6 and words in (0, size, 2 * size)
        taken[source] += words
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_knapsack_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 40, 4))
        counts = rng.integers(0, 3, len(sizes))
        budget = int(rng.integers(0, 120))
        best = max(s for t in itertools.product(*[range(c + 1) for c in counts])
                   if (s := int((np.array(t) * sizes).sum())) <= budget)
        take = knapsack(sizes, counts, budget)
        assert (take <= counts).all() and int((take * sizes).sum()) == best


def test_fit_keeps_to_the_budget_beyond_the_table():
    sizes, counts = np.array([1, 7, 1000]), np.array([500, 400, 300])
    for budget in (0, 1, 999, 150_000, 303_300):
        take = fit_counts(sizes, counts, budget, dp_budget=50)
        assert (take <= counts).all() and int((sizes * take).sum()) == min(budget, 303_300)


def test_empty_table(spark):
    assert mix(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mix(docs(spark, [(1, None), (2, "")])).collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
