"""Streaming cooldown (R1): per (group) state holds the last accepted time.

Within a micro-batch a group's rows arrive unordered, so they are sorted by
``(ts, id)`` and folded with the vectorised :func:`fold_after`; across
micro-batches arrival order is the order (as with requests arriving at a
server): a request earlier than the last accepted time plus the cooldown is
rejected, a late one (before the last accepted time) too, its wait counting
from its own time.  Given the same rows in one batch, the result equals
:func:`matchbook.operators.cooldown.cooldown_accept`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from matchbook.operators.cooldown import DEFAULT_COOLDOWN_SECONDS, fold_after


def cooldown_stream(requests: DataFrame, group_cols, ts_col: str = "ts", id_col: str = "event_id",
                    cooldown_seconds: int = DEFAULT_COOLDOWN_SECONDS) -> DataFrame:
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    src = requests.select(*groups, F.col(id_col).alias(id_col),
                          F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_us"))
    schema_fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    out_schema = ", ".join(f"{c} {schema_fields[c]}" for c in groups) + \
        f", {id_col} {schema_fields[id_col]}, accepted boolean, wait_minutes bigint"
    cd_us = int(cooldown_seconds) * 1_000_000

    def fold(key, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", id_col], kind="stable")
        us = pdf["_us"].to_numpy(np.int64)
        last = int(state.get[0]) if state.exists else None
        acc, wait = fold_after(us, last, cd_us)
        if acc.any():
            newest = int(us[np.flatnonzero(acc)[-1]])
            state.update((newest if last is None else max(last, newest),))
        out = pdf[groups + [id_col]].copy()
        out["accepted"] = acc
        out["wait_minutes"] = pd.array(np.where(acc, None, wait), dtype="Int64")
        yield out

    return src.groupBy(*groups).applyInPandasWithState(
        fold, out_schema, "last_accepted_us long", "append", GroupStateTimeout.NoTimeout)
