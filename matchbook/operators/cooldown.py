"""Request cooldown (R1, F7): accept a request only if at least
``cooldown`` has passed since the last *accepted* request of its group.

The rule is a fold (each decision depends on the previous acceptance), so
``lag`` is wrong and a per-group sort would put a hot group in one task.
This form is exact and stays distributed for any group size:

1. Number the requests by ``(group, ts, id)`` with a range-partitioned
   global index ``e`` (a hot group spreads over many partitions).
2. For each request add a probe at ``ts + cooldown`` and number requests
   and probes together.  The position of a probe, minus its own request's
   number, is how many requests precede ``ts + cooldown``; so the next
   acceptable request after ``i`` is request ``nxt(i)`` with no search.
3. Accepted requests are ``head, nxt(head), nxt(nxt(head)), ...``.  They are
   marked by pointer doubling: round ``k`` joins the marked set with the
   ``2^k``-step successor table and squares that table.  Joins are on
   unique request numbers, so there is no key skew, and the number of
   rounds is ``log2`` of the longest accepted chain.
4. The wait shown for a rejected request comes from the last accepted
   request of its group, which lies less than ``cooldown`` earlier: with
   time cut into ``cooldown``-wide buckets there is at most one accepted
   request per bucket, so an equi-join on (group, bucket) over the
   request's bucket and the one before finds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.ordering import with_global_index
from matchbook.session import cut_lineage

DEFAULT_COOLDOWN_SECONDS = 300
# Groups up to this many requests are folded in one task (memory bounded by
# this limit); larger groups take the distributed doubling path.
DEFAULT_MAX_GROUP_ROWS = 200_000


def _plus_seconds(col, seconds: int):
    return col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def cooldown_accept(requests: DataFrame, group_cols, ts_col: str = "ts", id_col: str = "event_id",
                    cooldown_seconds: int = DEFAULT_COOLDOWN_SECONDS,
                    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """Return ``group_cols + id + ts + accepted + wait_minutes``.

    ``wait_minutes`` is NULL for accepted requests and otherwise the whole
    minutes left of the cooldown at the time of the request.

    Group sizes come from a map-side-combined count.  Groups with more than
    ``max_group_rows`` requests can number at most total / max_group_rows,
    a proven bound, so that key table is broadcast to split the input
    without a skewed join.  Bounded groups are folded in one sorted pass
    per group; oversized groups use the distributed doubling plan.
    """
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    base = requests.select(*groups, F.col(ts_col).cast("timestamp").alias("_ts"),
                           F.col(id_col).alias("_id"))
    sizes = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    # the oversized keys are few (at most total / max_group_rows): keep them
    # once, so the request table is aggregated a single time
    big_keys = cut_lineage(sizes.where(F.col("_n") > max_group_rows).select(*groups))
    if cooldown_seconds <= 0:
        out = base.select(*groups, "_id", "_ts", F.lit(True).alias("accepted"),
                          F.lit(None).cast("long").alias("wait_minutes"))
    elif big_keys.isEmpty():
        out = _fold_bounded_groups(base, groups, cooldown_seconds)
    else:
        big = F.broadcast(big_keys.select(*[F.col(c).alias(f"_big_{c}") for c in groups]))
        same = [F.col(c).eqNullSafe(F.col(f"_big_{c}")) for c in groups]     # a NULL group is a group
        small = _fold_bounded_groups(base.join(big, same, "left_anti"), groups, cooldown_seconds)
        out = small.unionByName(_doubling(base.join(big, same, "left_semi"), groups, cooldown_seconds))
    return out.select(*groups, F.col("_id").alias(id_col), F.col("_ts").alias(ts_col),
                      "accepted", "wait_minutes")


def _group_starts(keys: pd.DataFrame) -> np.ndarray:
    """True where a row starts a new group (rows sorted by the keys); NULL
    keys compare equal, as in SQL ``PARTITION BY``."""
    prev = keys.shift()
    differs = (keys.ne(prev) & ~(keys.isna() & prev.isna())).any(axis=1).to_numpy()
    if len(differs):
        differs[0] = True
    return differs


def fold_sorted(starts: np.ndarray, us: np.ndarray, cd_us: int):
    """Cooldown over complete groups sorted by (group, time, id), vectorised.

    ``starts`` marks each group's first row, ``us`` holds times in
    microseconds.  Returns ``(accepted, wait_minutes)``.  The successor of
    request ``i`` -- the first request of its group at or after
    ``us[i] + cd_us`` -- comes from one stable sort of the requests merged
    with probes at ``us + cd_us`` (a probe sorts before a request at the same
    time); accepted requests are those reachable from each group's first
    request, marked by pointer doubling (log2 of the longest chain rounds).
    """
    n = len(us)
    idx = np.arange(n)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    if cd_us <= 0:
        return np.ones(n, bool), np.zeros(n, np.int64)
    gid = np.cumsum(starts) - 1
    group_end = np.append(np.flatnonzero(starts)[1:], n)[gid]
    t = np.concatenate([us + cd_us, us])
    kind = np.concatenate([np.zeros(n, np.int8), np.ones(n, np.int8)])
    order = np.lexsort((kind, t, np.concatenate([gid, gid])))     # stable; group is the major key
    pos = np.empty(2 * n, np.int64)
    pos[order] = np.arange(2 * n)
    first_after = pos[:n] - idx                                   # requests ordered before probe i
    jump = np.append(np.where(first_after < group_end, first_after, n), n)   # n: no successor
    if (first_after <= idx).any():
        raise ValueError("times must not decrease within a group")
    accepted = starts.copy()
    # successors lie strictly ahead, so 2^k-step jumps leave the rows after
    # at most log2(n) + 1 doublings
    for _ in range(n.bit_length() + 1):
        if not (jump[:n] < n).any():
            break
        reached = jump[np.flatnonzero(accepted)]
        accepted[reached[reached < n]] = True
        jump = jump[jump]                                         # 2^k -> 2^(k+1) steps
    last_acc = np.maximum.accumulate(np.where(accepted, idx, -1))  # a group's first row is accepted
    wait = np.where(accepted, 0, (cd_us - (us - us[last_acc])) // 60_000_000)
    return accepted, wait


def fold_after(us: np.ndarray, last: int | None, cd_us: int):
    """Cooldown of one group's sorted times after an accepted time ``last``.

    Times before ``last + cd_us`` are rejected, late ones (before ``last``)
    among them; the rest is folded by :func:`fold_sorted`.  Without a cooldown
    everything is accepted."""
    if last is None or cd_us <= 0:
        starts = np.zeros(len(us), bool)
        starts[:1] = True
        return fold_sorted(starts, us, cd_us)
    early = int(np.searchsorted(us, last + cd_us, "left"))
    starts = np.zeros(len(us) - early, bool)
    starts[:1] = True
    acc, wait = fold_sorted(starts, us[early:], cd_us)
    return (np.concatenate([np.zeros(early, bool), acc]),
            np.concatenate([(last + cd_us - us[:early]) // 60_000_000, wait]))


def _fold_bounded_groups(base: DataFrame, groups, cooldown_seconds: int) -> DataFrame:
    """Cooldown for groups proven to be bounded.

    Rows are hash-partitioned by group and sorted within each partition, so
    every task streams whole groups in time order.  Each Arrow batch is cut
    after its last complete group (the trailing group is carried into the
    next batch; a group holds at most the bounded number of rows), and each
    chunk of complete groups is folded by :func:`fold_sorted` with numpy --
    no Python loop over rows.
    """
    cd_us = int(cooldown_seconds) * 1_000_000
    src = (base.select(*groups, "_id", F.unix_micros("_ts").alias("_us"))
               .repartition(*groups)
               .sortWithinPartitions(*groups, "_us", "_id"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in groups) + \
        f", _id {types['_id']}, _us bigint, accepted boolean, wait_minutes bigint"

    def emit(chunk):
        acc, wait = fold_sorted(_group_starts(chunk[groups]), chunk["_us"].to_numpy(np.int64), cd_us)
        out = chunk.copy()
        out["accepted"] = acc
        out["wait_minutes"] = pd.array(np.where(acc, None, wait), dtype="Int64")
        return out

    def fold(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last_start = int(np.flatnonzero(_group_starts(pdf[groups]))[-1])
            carry = pdf.iloc[last_start:].reset_index(drop=True)
            if last_start:
                yield emit(pdf.iloc[:last_start].reset_index(drop=True))
        if carry is not None and len(carry):
            yield emit(carry)

    return src.mapInPandas(fold, schema).withColumn("_ts", F.timestamp_micros("_us")).drop("_us")


def _doubling(base: DataFrame, groups, cooldown_seconds: int, max_rounds: int = 64) -> DataFrame:
    """Distributed exact plan for oversized groups (see module docstring)."""
    ev = with_global_index(base, [*groups, "_ts", "_id"], "_e")

    # (2) next acceptable request, via the merged request/probe order.
    probes = ev.select(*groups, _plus_seconds(F.col("_ts"), cooldown_seconds).alias("_t"),
                       F.lit(0).alias("_kind"), "_e")
    events = ev.select(*groups, F.col("_ts").alias("_t"), F.lit(1).alias("_kind"), "_e")
    merged = with_global_index(probes.unionByName(events), [*groups, "_t", "_kind", "_e"], "_u")
    bounds = ev.groupBy(*groups).agg(F.min("_e").alias("_first"), F.max("_e").alias("_last"))
    ends = bounds.select(*[F.col(c).alias(f"_b_{c}") for c in groups], "_last")
    nxt = (merged.where(F.col("_kind") == 0)
                 .join(F.broadcast(ends), [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in groups])
                 .select("_e", (F.col("_u") - F.col("_e") + 1).alias("_nxt"), "_last")
                 .where(F.col("_nxt") <= F.col("_last"))
                 .select("_e", "_nxt"))

    # (3) pointer doubling from each group's first request.
    marked = cut_lineage(bounds.select(F.col("_first").alias("_e")))
    jump = cut_lineage(nxt)
    for _ in range(max_rounds):
        if jump.isEmpty():
            break
        reached = marked.join(jump, "_e").select(F.col("_nxt").alias("_e"))
        # positions reached in round k are all new (chains have no cycles)
        marked = cut_lineage(marked.unionByName(reached))
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, F.col("a._nxt") == F.col("b._e"))
                            .select(F.col("a._e").alias("_e"), F.col("b._nxt").alias("_nxt")))
    else:
        raise RuntimeError("cooldown chain longer than 2**max_rounds")

    flagged = ev.join(marked.withColumn("accepted", F.lit(True)), "_e", "left").withColumn(
        "accepted", F.coalesce(F.col("accepted"), F.lit(False)))

    # (4) wait time for rejected requests from the blocking accepted one; the
    # unique request number identifies a row (ids may repeat)
    bucket = F.floor(F.unix_seconds(F.col("_ts")) / cooldown_seconds)
    acc = flagged.where("accepted").select(
        *[F.col(c).alias(f"_a_{c}") for c in groups], bucket.alias("_ab"),
        F.col("_ts").alias("_acc_ts"), F.col("_e").alias("_acc_e"))
    rej = flagged.where(~F.col("accepted")).select(
        *groups, "_e", F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    same = [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in groups] + [F.col("_b") == F.col("_ab")]
    blocker = (rej.join(acc, same).where(F.col("_acc_e") < F.col("_e"))
                  .groupBy("_e").agg(F.max("_acc_ts").alias("_acc_ts")))
    elapsed = (F.unix_micros(F.col("_ts")) - F.unix_micros(F.col("_acc_ts"))) / 1e6
    wait = F.floor((F.lit(float(cooldown_seconds)) - elapsed) / 60).cast("long")
    return (flagged.join(blocker, "_e", "left")
                   .select(*groups, "_id", "_ts", "accepted",
                           F.when(~F.col("accepted"), wait).alias("wait_minutes")))


def fold_few(us: list[int], last: int | None, cd_us: int):
    """:func:`fold_after` of a short list of sorted times, as a loop."""
    accepted, wait = [], []
    for t in us:
        ok = last is None or cd_us <= 0 or t >= last + cd_us
        accepted.append(ok)
        wait.append(0 if ok else (last + cd_us - t) // 60_000_000)
        if ok:
            last = t
    return accepted, wait
