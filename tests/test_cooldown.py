import datetime as dt
import math
import random

import numpy as np

from matchbook.operators.cooldown import cooldown_accept


def brute(rows, cd):
    out, last = {}, {}
    for g, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        lt = last.get(g)
        if lt is None or (ts - lt).total_seconds() >= cd:
            last[g] = ts
            out[i] = (True, None)
        else:
            out[i] = (False, math.floor((cd - (ts - lt).total_seconds()) / 60))
    return out


def _rows(seed, n=3000):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.4 else f"g{rnd.randrange(25)}"      # one group ~40%
        ts = t0 + dt.timedelta(seconds=rnd.randrange(0, 86400 * 2))
        if rnd.random() < 0.05 and rows:
            ts = rows[-1][1]                                               # equal timestamps
        rows.append((g, ts, i))
    return rows


def test_cooldown_matches_sequential_fold(spark):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "g string, ts timestamp, event_id long")
    for cd in (300, 6 * 3600):
        want = brute(rows, cd)
        # default: every group folded in one pass
        got = {r.event_id: (r.accepted, r.wait_minutes)
               for r in cooldown_accept(df, "g", "ts", "event_id", cd).collect()}
        assert got == want
        # hot group (~40% of rows) forced onto the distributed doubling plan
        got = {r.event_id: (r.accepted, r.wait_minutes)
               for r in cooldown_accept(df, "g", "ts", "event_id", cd, max_group_rows=500).collect()}
        assert got == want
        # every group on the doubling plan
        got = {r.event_id: (r.accepted, r.wait_minutes)
               for r in cooldown_accept(df, "g", "ts", "event_id", cd, max_group_rows=0).collect()}
        assert got == want


def test_cooldown_exact_boundary(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0, 1), ("u", t0 + dt.timedelta(seconds=299), 2),
            ("u", t0 + dt.timedelta(seconds=300), 3), ("u", t0 + dt.timedelta(seconds=301), 4)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, event_id long")
    for limit in (200_000, 0):
        got = {r.event_id: (r.accepted, r.wait_minutes)
               for r in cooldown_accept(df, "g", "ts", "event_id", 300, max_group_rows=limit).collect()}
        assert got == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 4)}


def test_fold_sorted_matches_sequential_fold():
    import numpy as np
    from matchbook.operators.cooldown import fold_sorted
    rnd = random.Random(3)
    for _ in range(2000):
        n = rnd.randrange(0, 60)
        rows = sorted((rnd.randrange(4), rnd.choice([rnd.randrange(5000), rnd.randrange(50)]) * 1_000_000, i)
                      for i in range(n))
        cd = rnd.choice([0, 1, 7, 300, 1000]) * 1_000_000
        g = np.array([r[0] for r in rows])
        us = np.array([r[1] for r in rows], np.int64)
        starts = np.ones(n, bool)
        starts[1:] = g[1:] != g[:-1]
        acc, wait = fold_sorted(starts, us, cd)
        last = {}
        for k, (gg, t, _) in enumerate(rows):
            lt = last.get(gg)
            if lt is None or t - lt >= cd:
                last[gg] = t
                assert acc[k]
            else:
                assert not acc[k] and wait[k] == (cd - (t - lt)) // 60_000_000


def test_cooldown_groups_spanning_many_arrow_batches(spark):
    rows = _rows(11, n=1500)
    df = spark.createDataFrame(rows, "g string, ts timestamp, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cd in (300, 6 * 3600):
            got = {r.event_id: (r.accepted, r.wait_minutes)
                   for r in cooldown_accept(df, "g", "ts", "event_id", cd).collect()}
            assert got == brute(rows, cd)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _brute(rows, cooldown):
    """{row number: (accepted, wait)} of (group, seconds, id) rows."""
    last, out = {}, {}
    for i in sorted(range(len(rows)), key=lambda k: (str(rows[k][0]), rows[k][1], rows[k][2])):
        g, t, _ = rows[i]
        ok = g not in last or t >= last[g] + cooldown
        out[i] = (ok, None if ok else int((last[g] + cooldown - t) // 60))
        if ok:
            last[g] = t
    return out


def test_both_plans_agree_on_nulls_repeats_and_no_cooldown(spark):
    import collections
    import datetime as dt
    import random
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2]), rnd.randrange(4000), rnd.randrange(20)) for _ in range(300)]
    rows += [(3, 50, 7)] * 5 + [(1, 0, 1), (2, 0, 1)]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(g, t0 + dt.timedelta(seconds=t), i) for g, t, i in rows], "g long, ts timestamp, id long")
    for cooldown in (0, 90, 700):
        want = collections.Counter((rows[k][0], rows[k][1], rows[k][2], *v) for k, v in _brute(rows, cooldown).items())
        for limit in (0, 40, 200_000):
            out = cooldown_accept(df, "g", "ts", "id", cooldown, limit).collect()
            got = collections.Counter((r.g, int((r.ts - t0).total_seconds()), r.id, r.accepted, r.wait_minutes) for r in out)
            assert got == want, (cooldown, limit)


def test_late_times_after_a_state_are_rejected():
    import numpy as np
    import pytest
    from matchbook.operators.cooldown import fold_after, fold_sorted
    s = 1_000_000
    acc, wait = fold_after(np.array([0, 10, 1040, 1060, 1100, 1121]) * s, 1000 * s, 60 * s)
    assert list(acc) == [False, False, False, True, False, True] and list(wait[:3]) == [17, 17, 0]
    assert fold_after(np.array([5, 6]) * s, 1000 * s, 0)[0].all()
    with pytest.raises(ValueError):
        fold_sorted(np.array([True, False]), np.array([1000, 0]) * s, 10 * s)


def test_few_rows_fold_as_many_do():
    from matchbook.operators.cooldown import fold_after, fold_few
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 40):
        for last in (None, 0, 500_000_000):
            for cooldown in (0, 60_000_000, 300_000_000):
                us = np.sort(rnd.integers(0, 1_500_000_000, n))
                accepted, wait = fold_after(us, last, cooldown)
                few = fold_few(us.tolist(), last, cooldown)
                assert (accepted.tolist(), wait.tolist()) == few
