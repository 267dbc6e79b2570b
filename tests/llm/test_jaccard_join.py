import random

from helpers import clashing, docs, prose, shingles
import pytest

from matchbook.llm import jaccard_join as j
from matchbook.llm.components import components


def brute(rows):
    """{row number: (set size, component)}."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    live = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    for a in range(len(live)):
        for b in range(a):
            x, y = sets[live[a]], sets[live[b]]
            if 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(rows[live[a]][0]), find(rows[live[b]][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(shingles(t)), None if i is None else (find(i) if sets[n] else i)) for n, (i, t) in enumerate(rows)), key=repr)


def edited(seed, words, share):
    r = random.Random(seed)
    return " ".join(f"e{seed}x{k}" if r.random() < share else w for k, w in enumerate(words))


def corpus():
    rows = []
    for g in range(12):                                     # bases and copies around the threshold
        base = prose(g, 30 + 25 * g).split()
        rows += [(1000 * g + c, edited(1000 * g + c, base, 0.004 * c)) for c in range(12)]
    chain = prose(77, 400).split()                          # each links with the next only
    for c in range(8):
        rows.append((50_000 + c, " ".join(chain[20 * c:20 * c + 250])))
    passage = prose(99, 60)                                 # one passage in many unlike texts
    rows += [(60_000 + c, f"{prose(500 + c, 20 + c)} {passage} {prose(900 + c, 15)}") for c in range(60)]
    rows += [(70_000 + c, f"{passage} tail{c}") for c in range(6)]
    rows += [(80_000, None), (80_001, ""), (80_002, " \n"), (80_003, "one two"), (80_004, "One  TWO"), (80_005, "two one"),
             (80_006, "a b c d e"), (80_007, prose(4, 30_000)), (80_008, prose(4, 29_000)), (None, prose(1, 55)), (None, None)]
    rows += [(3, rows[3][1])] * 40 + [(90_000 + c, rows[5][1]) for c in range(40)]
    rows += [(95_000, rows[0][1]), (95_000, rows[30][1])]   # one id, two texts
    return rows


@pytest.mark.parametrize("common", [64, 1])
def test_matches_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(j, "COMMON", common)
    monkeypatch.setattr(j, "BLOCK", 4)
    monkeypatch.setattr(j, "LOT", 3)
    rows = corpus()
    table = clashing(docs(spark, rows), "id", "key", "n", "block", "component_id", "rep", "comp")
    got = sorted(map(tuple, j.jaccard_components(table).collect()), key=repr)
    assert got == brute(rows)


def test_blocks_and_lots_are_cut_by_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(j, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(j, "LOT_BYTES", 20_000)
    base = prose(5, 500).split()                            # about 3 kB each, far fewer than BLOCK texts
    rows = [(c, edited(c, base, 0.002 * (c % 30))) for c in range(60)]
    rows += [(100 + c, f"{rows[c][1]} " + f"{rows[c][1]} " * 8) for c in range(3)]     # few shingles, many bytes
    groups = j._groups

    def seen(active):
        out = groups(active)
        held.append(out.groupBy("leader", "block").sum("bytes").collect())
        return out
    monkeypatch.setattr(j, "_groups", seen)
    got = sorted(map(tuple, j.jaccard_components(docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert len(held[0]) > 8 and max(r[2] for r in held[0]) < 3 * 27_000 < sum(r[2] for r in held[0])


def test_unions_bound_and_open(spark):
    from matchbook.llm.shingles import shingle_set
    sets = [shingle_set(t.encode()) for t in (prose(1, 80), prose(1, 78) + " x y", prose(2, 60))]
    block = j.OpenBlock([1, 2, 3], [1, 2, 3], sets)
    assert list(block.overlaps(sets[0])) == [len(set(sets[0]) & set(s)) for s in sets]
    assert block.overlaps(shingle_set(prose(9, 70).encode())) is None


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in got} and set(parent) - set(got) <= {a for a, b in edges if a == b}


def test_empty_table(spark):
    assert j.jaccard_components(docs(spark, [])).count() == 0
    got = j.jaccard_components(docs(spark, [(1, None), (2, "a b")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 1, 2)]
