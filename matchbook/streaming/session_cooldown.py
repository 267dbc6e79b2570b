"""Cooldown per session with timers (R1): state leaves when it can no longer matter.

The state of a group (for instance user, implementation and session) is the time
of its last accepted request.  With it goes one event-time timer at the end of the
cooldown: when the watermark has passed it, no request that can still come is
rejected, and the state is cleared.  So the state holds the groups of the last
cooldown, not every session there ever was.

Rows later than ``delay`` are dropped by the watermark, as in every event-time
operator; within it a late row is judged as in
:func:`matchbook.streaming.cooldown_stream.cooldown_stream`.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from matchbook.operators.cooldown import DEFAULT_COOLDOWN_SECONDS, fold_after, fold_few

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A group's rows of one micro-batch are mostly few: up to so many are folded in a
# loop, which costs less than the arrays of the vectorised fold.
FEW_ROWS = 256


@contextmanager
def timer_state(spark: SparkSession):
    """The state store that timers need, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class LastAccepted(StatefulProcessor):
    def __init__(self, cooldown_us: int, names: list[str], id_col: str):
        self.cooldown_us, self.names, self.id_col = cooldown_us, names, id_col

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_accepted", "us long")

    def ends_ms(self, us: int) -> int:
        return -(-(us + self.cooldown_us) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        if len(pdf) > 1:
            pdf = pdf.sort_values(["request_us", self.id_col], kind="stable")
        us = pdf["request_us"].to_numpy(np.int64)
        held = self.last.get()
        last = int(held[0]) if held else None
        if len(us) > FEW_ROWS:
            accepted, wait = fold_after(us, last, self.cooldown_us)
        else:
            accepted, wait = map(np.array, fold_few(us.tolist(), last, self.cooldown_us))
        if accepted.any():
            newest = int(us[np.flatnonzero(accepted)[-1]])
            if last is None or newest > last:
                if last is not None:
                    self.handle.deleteTimer(self.ends_ms(last))
                self.last.update((newest,))
                self.handle.registerTimer(self.ends_ms(newest))
        yield pd.DataFrame({**{c: pdf[c].array for c in (*self.names, self.id_col)}, "accepted": accepted,
                            "wait_minutes": pd.arrays.IntegerArray(wait.astype(np.int64), accepted.astype(bool))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def session_cooldown_stream(requests: DataFrame, group_cols, ts_col: str = "ts", id_col: str = "event_id",
                            cooldown_seconds: int = DEFAULT_COOLDOWN_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Rows (group, id, accepted, wait_minutes).  Start the query inside
    :func:`timer_state`."""
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    timed = (requests.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
                     .select(*groups, id_col, ts_col, F.unix_micros(ts_col).alias("request_us")))
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*groups, id_col]) + ", accepted boolean, wait_minutes bigint"
    return timed.groupBy(*groups).transformWithStateInPandas(
        statefulProcessor=LastAccepted(int(cooldown_seconds) * 1_000_000, groups, id_col),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")
