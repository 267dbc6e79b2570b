import datetime as dt
import time
from unittest.mock import Mock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchbook.operators.cooldown import cooldown_accept
from matchbook.operators.identity import dedup_first
from matchbook.sources import keyed_store as ks
from matchbook.sources import manifest
from matchbook.streaming.runner import run_foreach_batch, run_to_table, stream_dirs
from matchbook.streaming.session_cooldown import session_cooldown_stream, timer_state
from matchbook.streaming.store_ingest import store_ingest
from matchbook.streaming.unanswered_stream import answered_requests

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def land(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ASKED, GIVEN = "request_id long, user_id long, ts timestamp", "user_id long, reply_id long, reply_ts timestamp"


def test_a_late_reply_answers_and_an_expired_one_does_not(spark, tmp_dir):
    asked, given, query = f"{tmp_dir}/asked", f"{tmp_dir}/given", f"{tmp_dir}/query"

    def run():
        joined = answered_requests(stream(spark, asked, ASKED), stream(spark, given, GIVEN), "user_id", within="60 seconds",
                                   delay="30 seconds")
        return sorted((r.request_id, r.reply_id) for r in run_to_table(joined, "t-unanswered", path=query).collect())
    land(spark, asked, ASKED, [(1, 1, at(0)), (2, 2, at(10)), (3, 3, at(20)), (4, 4, at(100))])
    land(spark, given, GIVEN, [(3, 30, at(25)), (9, 90, at(40))])
    assert run() == [(3, 30)]                                   # 1 and 2 may still be answered
    # request 1 is answered in time though its reply lands late, 2 is answered too late
    land(spark, asked, ASKED, [(5, 5, at(1000))])
    land(spark, given, GIVEN, [(1, 10, at(59)), (2, 20, at(71)), (4, 40, at(160)), (4, 41, at(161)), (9, 91, at(1000))])
    assert run() == sorted([(1, 10), (2, None), (3, 30), (4, 40)], key=lambda r: r[0])
    land(spark, asked, ASKED, [(6, 6, at(5000))])
    land(spark, given, GIVEN, [(9, 92, at(5000))])
    assert (5, None) in run()


REQ = "event_id long, user_id long, session string, ts timestamp"


def requests(n=300):
    return [(i, i % 3, f"s{i // 90}", at(i * i % 997 + i * 20)) for i in range(n)]


def test_session_cooldown_equals_batch(spark, tmp_dir):
    path = f"{tmp_dir}/req"
    land(spark, path, REQ, requests())
    with timer_state(spark):
        got = run_to_table(session_cooldown_stream(stream(spark, path, REQ), ["user_id", "session"], cooldown_seconds=300,
                                                   delay="1 hour"), "t-session")
    want = cooldown_accept(spark.createDataFrame(requests(), REQ), ["user_id", "session"], "ts", "event_id", 300)
    cols = ("user_id", "session", "event_id", "accepted", "wait_minutes")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_state_shrinks_after_the_gap_and_carries_over_batches(spark, tmp_dir):
    path, query = f"{tmp_dir}/req", f"{tmp_dir}/query"

    def run():
        out, state = stream_dirs(spark, "t", query)
        s = session_cooldown_stream(stream(spark, path, REQ), ["user_id", "session"], cooldown_seconds=300, delay="10 seconds")
        with timer_state(spark):
            q = s.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return held[-1], {r.event_id: r.accepted for r in spark.read.parquet(out).collect()}
    land(spark, path, REQ, [(i, i, "a", at(i)) for i in range(40)])
    full, got = run()
    assert full >= 40 and all(got.values())
    land(spark, path, REQ, [(100, 0, "a", at(150)), (101, 0, "b", at(151))])
    _, got = run()
    assert got[100] is False and got[101] is True               # the same user in another session
    land(spark, path, REQ, [(200, 50, "a", at(100_000))])
    run()
    land(spark, path, REQ, [(201, 51, "a", at(200_000))])
    left, got = run()
    assert left < full / 4 and got[200] and got[201]


POST = "job_hash string, page int, pos int, title string"


def new_store(spark, tmp_dir, rows=()):
    root = f"{tmp_dir}/store"
    ks.create_store(spark.createDataFrame(list(rows), POST), root, "job_hash", 8)
    return root


def test_ingest_keeps_the_first_in_source_order_over_batches(spark, tmp_dir):
    rows = [(f"h{i % 17}", 50 - i // 10, i % 10, f"t{i}") for i in range(200)] + [(None, 1, 1, "no identity")]
    path, root, out = f"{tmp_dir}/landed", new_store(spark, tmp_dir), f"{tmp_dir}/changes"
    for lo in range(0, len(rows), 70):                          # later batches hold earlier pages
        land(spark, path, POST, rows[lo:lo + 70])
        time.sleep(1.1)
    run_foreach_batch(stream(spark, path, POST), "t-ingest", store_ingest(root, out, ["page", "pos"]))
    want = dedup_first(spark.createDataFrame(rows, POST).where("job_hash is not null"), "job_hash", ["page", "pos"])
    assert sorted(map(tuple, ks.read_store(spark, root).collect())) == sorted(map(tuple, want.collect()))
    kinds = {(r.kind, r.epoch_id): r["count"] for r in spark.read.parquet(out).groupBy("kind", "epoch_id").count().collect()}
    assert kinds == {("new", 0): 17, ("correction", 1): 17, ("correction", 2): 17}


def test_replayed_epochs_change_nothing(spark, tmp_dir, monkeypatch):
    root, out = new_store(spark, tmp_dir, [("a", 5, 0, "old")]), f"{tmp_dir}/changes"
    handler = store_ingest(root, out, ["page", "pos"])
    batch = spark.createDataFrame([("a", 2, 0, "earlier"), ("b", 9, 0, "new"), ("b", 9, 1, "repeat")], POST)

    def changes():
        return sorted((r.job_hash, r.title, r.kind, r.epoch_id) for r in spark.read.parquet(out).collect())
    with monkeypatch.context() as m:                            # lost between the change table and the store
        m.setattr(manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            handler(batch, 3)
    first = changes()
    handler(batch, 3)
    stored = sorted(map(tuple, ks.read_store(spark, root).collect()))
    assert changes() == first == [("a", "earlier", "correction", 3), ("b", "new", "new", 3)]
    assert stored == [("a", 2, 0, "earlier"), ("b", 9, 0, "new")]
    version = manifest.read(spark, root)[0]
    handler(batch, 3)                                           # committed already
    handler(batch, 4)                                           # nothing new
    handler(batch.limit(0), 5)
    assert changes() == first and manifest.read(spark, root)[0] == version
    assert sorted(map(tuple, ks.read_store(spark, root).collect())) == stored
    handler(spark.createDataFrame([("a", 1, 7, "first"), ("a", 1, 8, "later")], POST).orderBy(F.desc("pos")), 6)
    assert ks.read_store(spark, root).where("job_hash = 'a'").first()["title"] == "first"


def test_session_cooldown_folds_few_rows_in_a_loop_and_many_as_arrays(spark, tmp_dir, monkeypatch):
    from matchbook.streaming import session_cooldown as sc
    path = f"{tmp_dir}/req"
    rows = [(i, 0 if i % 2 else i % 20, "s", at(i % 700 * 7)) for i in range(3 * sc.FEW_ROWS)]
    land(spark, path, REQ, rows)
    with timer_state(spark):
        got = run_to_table(session_cooldown_stream(stream(spark, path, REQ), ["user_id", "session"], cooldown_seconds=300,
                                                   delay="2 hours"), "t-session")
    want = cooldown_accept(spark.createDataFrame(rows, REQ), ["user_id", "session"], "ts", "event_id", 300)
    cols = ("user_id", "session", "event_id", "accepted", "wait_minutes")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    # few rows are never sorted, searched and merged as arrays
    monkeypatch.setattr(sc, "fold_after", None)
    processor = sc.LastAccepted(300_000_000, ["user_id"], "event_id")
    processor.handle, processor.last = Mock(), Mock(get=lambda: (0,))
    frame = pd.DataFrame({"user_id": [1, 1, 1], "event_id": [3, 2, 1], "request_us": [600_000_000, 300_000_000, 5]})
    out = next(processor.handleInputRows((1,), iter([frame]), None))
    assert out["event_id"].tolist() == [1, 2, 3] and out["accepted"].tolist() == [False, True, True]
    assert out["wait_minutes"].isna().tolist() == [False, True, True] and out["wait_minutes"][0] == 4
    processor.last.update.assert_called_once_with((600_000_000,))
