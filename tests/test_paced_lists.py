import os
import random
import time

import pytest
from pyspark.sql import functions as F

from matchbook.operators.embedding import Calls, embed_texts
from matchbook.operators.paced_calls import Lane, paced_calls
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.textfilter import write_routed
from matchbook.operators.top_list_store import apply_delta, build_reserve, shown


def recorder(folder):
    """A client that writes down when it is called and fails on prompts that say so."""
    def client(prompts):
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
            f.write(f"{time.time()} {len(prompts)}\n")
        marker = os.path.join(folder, "once")
        if "flaky" in prompts and not os.path.exists(marker):
            open(marker, "w").close()
            raise TimeoutError("try again")
        if "broken" in prompts:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]
    return client


def calls(folder):
    return sorted(float(line.split()[0]) for n in os.listdir(folder) if n != "once"
                  for line in open(os.path.join(folder, n)))


def test_one_pace_over_all_tasks_and_batches(spark, tmp_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "k long, p string").repartition(6)
        replies, dead = paced_calls(df, "p", "k", recorder(tmp_dir), rate=20, lanes=3, batch_size=2)
        assert sorted(map(tuple, replies.collect())) == [(i, f"P{i}") for i in range(60)] and dead.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times = calls(tmp_dir)
    assert len(times) >= 30
    # at most the rate in any second, with some room for the wake-up of a sleeping task
    assert all(sum(1 for u in times if t <= u < t + 1) <= 22 for t in times)
    assert times[-1] - times[0] >= (len(times) - 4) / 20


def test_failed_calls_are_repeated_and_then_dead_letters(spark, tmp_dir):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "flaky", "b", "broken", "c"])], "k long, p string")
    replies, dead = paced_calls(df, "p", "k", recorder(tmp_dir), rate=50, lanes=2, batch_size=1, max_attempts=3)
    assert sorted(map(tuple, replies.collect())) == [(0, "A"), (1, "FLAKY"), (2, "B"), (4, "C")]
    assert [tuple(r) for r in dead.collect()] == [(3, "broken", 3, "RuntimeError: no answer")]
    assert len(calls(tmp_dir)) == 4 + 1 + 3                     # read twice above, called once
    short = lambda prompts: prompts[:-1]                        # noqa: E731
    _, dead = paced_calls(df.limit(1), "p", "k", short, rate=50, lanes=1, max_attempts=1)
    assert dead.first()["error"].startswith("ValueError")


def test_lane_slots_do_not_meet(monkeypatch):
    now = [100.0]
    monkeypatch.setattr(time, "time", lambda: now[0])
    monkeypatch.setattr(time, "sleep", lambda s: now.__setitem__(0, now[0] + s))
    slots = {}
    for number in range(3):
        now[0] = 100.0
        lane = Lane(number, 3, 10.0, 100.0)
        for k in range(5):
            lane.wait(2 if k == 3 else 0)
            slots.setdefault(round((now[0] - 100.0) * 10, 6), []).append(number)
            now[0] += 0.01
    assert all(len(v) == 1 and v[0] == int(k) % 3 for k, v in slots.items()) and len(slots) == 15


def test_the_pause_holds_between_batches(monkeypatch, spark):
    slept = []
    monkeypatch.setattr(time, "sleep", slept.append)
    model = Calls(lambda items: [i * 2 for i in items], 3, 0.5)
    assert model([1, 2, 3, 4]) == [2, 4, 6, 8] and model([5]) == [10] and model([]) == [] and model([6]) == [12]
    assert slept == [0.5, 0.5, 0.5]                             # four calls, three pauses
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([(i, "a b") for i in range(6)], "k long, t string").coalesce(1)
        t0 = time.time()
        assert embed_texts(df, "k", "t", pause_seconds=0.4).count() == 6
        assert embed_texts(df, "k", "t", pause_seconds=0.4).agg(F.sum(F.size("vec"))).first()[0] == 6 * 64
        assert time.time() - t0 >= 0.8                          # three batches of one call each
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


REV = "user_id long, job_hash long, score double"


def test_lists_by_deltas_equal_ranking_everything(spark):
    r = random.Random(7)
    store = {(u, j): float(r.randrange(12)) for u in range(8) for j in range(3 + 9 * u)}
    df = spark.createDataFrame([(*k, v) for k, v in store.items()], REV)
    reserve = build_reserve(df, "user_id", depth=8)
    done, again = 0, 0
    for step in range(6):
        delta = {}
        for _ in range(25 if step % 2 else 6):
            u = r.randrange(9)
            best = sorted((k for k in store if k[0] == u), key=lambda k: (-store[k], k[1]))
            if best and r.random() < 0.6:                       # what is on top goes or changes
                delta[best[min(len(best) - 1, r.randrange(5))]] = None if r.random() < 0.6 else float(r.randrange(12))
            else:
                delta[u, 100 + r.randrange(40)] = float(r.randrange(12))
        for k, v in delta.items():
            store.pop(k, None)
            if v is not None:
                store[k] = v
        after = spark.createDataFrame([(*k, v) for k, v in store.items()], REV)
        counts = {}
        reserve = apply_delta(reserve, spark.createDataFrame([(*k, v) for k, v in delta.items()], REV), after, "user_id", 4,
                              depth=8, counts=counts)
        want = top_n_per_group(after, "user_id", "score", 4, "job_hash")
        cols = ("user_id", "rank", "job_hash", "score")
        assert sorted(map(tuple, shown(reserve, 4).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
        done, again = done + counts["changed"], again + counts["recomputed"]
    assert 0 < again < done / 2


def test_reviews_of_other_users_are_not_read(spark):
    df = spark.createDataFrame([(u, j, float(j % 5)) for u in (1, 2) for j in range(50)], REV)
    reserve = build_reserve(df, "user_id", depth=10)
    lost = spark.createDataFrame([], REV)                       # would give nothing if it were read
    out = apply_delta(reserve, spark.createDataFrame([(1, 4, None), (1, 900, 7.0)], REV), lost, "user_id", 3, depth=10)
    got = {(r["user_id"], r["rank"]): r["job_hash"] for r in shown(out, 3).collect()}
    assert got[1, 1] == 900 and got[1, 2] == 9 and got[2, 1] == 4
    counts = {}
    gone = [(1, j, None) for j in range(4, 50, 5)]              # all of the reserve
    apply_delta(reserve, spark.createDataFrame(gone, REV), df.where("score < 4"), "user_id", 3, depth=10, counts=counts)
    assert counts == {"changed": 1, "recomputed": 1}
    assert build_reserve(lost, "user_id").count() == 0


def test_routing_counts_come_from_the_writing_pass(spark, tmp_dir):
    df = spark.createDataFrame([(i, lang) for i, lang in enumerate(["fr", "EN", "de", None, "es", "en"])], "i long, lang string")
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    counts = write_routed(df.mapInPandas(touch, df.schema), f"{tmp_dir}/routed")
    assert counts == {"rows_in": 6, "routed": 3, "rejected": 3} and seen.value == 6      # one scan
    rows = spark.read.parquet(f"{tmp_dir}/routed").collect()
    assert len(rows) == 6 and {r["model_lang"] for r in rows if r["routed"] == "true"} == {"FR", "EN"}
    assert write_routed(df.limit(0), f"{tmp_dir}/none") == {"rows_in": 0, "routed": 0, "rejected": 0}
    with pytest.raises(Exception, match="(?i)exist"):
        write_routed(df, f"{tmp_dir}/routed")
