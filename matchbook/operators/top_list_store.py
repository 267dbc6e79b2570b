"""Top lists kept up by deltas.

Beside the N shown rows a group keeps a reserve: its best ``depth`` rows.  What the
reserve says is exact down to its last row (its floor): every review that ranks at
or before the floor is in it.  A delta of changed and removed reviews therefore
needs the reserve alone -- changed rows leave, new scores that rank at or before the
floor enter -- until fewer than N rows are left above the floor.  Only then are
that group's reviews ranked anew from the store.  A group whose reviews all fit is
``complete`` and has no floor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.sizing import broadcast_if_small
from matchbook.session import cut_lineage

DEFAULT_DEPTH = 40


def build_reserve(reviews: DataFrame, group_cols, depth: int = DEFAULT_DEPTH, key: str = "job_hash") -> DataFrame:
    """Rows (group, key, score, place, complete): the ``depth`` best reviews of each
    group by (score desc, key).  Reviews without a score are none."""
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    ranked = top_n_per_group(reviews.where(F.col("score").isNotNull()).select(*groups, key, "score"), groups, "score",
                             depth + 1, key, "place")
    return _with_complete(ranked, groups, depth)


def _with_complete(ranked: DataFrame, groups: list[str], depth: int, before: DataFrame | None = None) -> DataFrame:
    """Cut ranked rows to ``depth`` and say whether their group is complete: it was
    (``before``: groups with ``complete``) and nothing was cut off."""
    sizes = ranked.groupBy(*groups).agg((F.max("place") <= depth).alias("complete"))
    if before is not None:
        sizes = sizes.join(before.withColumnRenamed("complete", "_was"), groups, "left").select(
            *groups, (F.col("complete") & F.coalesce("_was", F.lit(True))).alias("complete"))
    return ranked.where(F.col("place") <= depth).join(sizes, groups)


def apply_delta(reserve: DataFrame, delta: DataFrame, reviews_after: DataFrame, group_cols, n: int,
                depth: int = DEFAULT_DEPTH, key: str = "job_hash", counts: dict | None = None) -> DataFrame:
    """The reserve after ``delta(group, key, score)``, one row for each changed
    review, its score NULL when it was removed.

    ``reviews_after`` (the store with the delta in it) is read only for groups whose
    reserve is exhausted.  Groups without a change are passed through.  ``counts``,
    when given, gets ``changed`` and ``recomputed`` groups.
    """
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    delta = cut_lineage(delta.select(*groups, key, "score"))
    touched, _ = broadcast_if_small(delta.select(*groups).distinct())
    mine = cut_lineage(reserve.join(touched, groups, "left_semi"))
    rest = reserve.join(touched, groups, "left_anti")
    # a group the reserve does not know had no reviews: it is complete
    last = mine.groupBy(*groups).agg(F.max(F.struct("place", F.col("score").alias("_floor"), F.col(key).alias("_last"))).alias("l"),
                                     F.first("complete").alias("complete")).select(*groups, "l._floor", "l._last", "complete")
    above = F.coalesce("complete", F.lit(True)) | (F.col("score") > F.col("_floor")) | \
        ((F.col("score") == F.col("_floor")) & (F.col(key) <= F.col("_last")))
    fresh = delta.where("score is not null").join(last, groups, "left").where(above).select(*groups, key, "score")
    kept = mine.join(delta.select(*groups, key), [*groups, key], "left_anti").select(*groups, key, "score")
    ranked = top_n_per_group(kept.unionByName(fresh), groups, "score", depth + 1, key, "place")
    state = last.select(*groups, "complete")
    now = cut_lineage(_with_complete(ranked, groups, depth, state))
    sizes = delta.select(*groups).distinct().join(state, groups, "left").join(
        now.groupBy(*groups).agg(F.count(F.lit(1)).alias("have")), groups, "left")
    short = cut_lineage(sizes.where(~F.coalesce("complete", F.lit(True)) & (F.coalesce("have", F.lit(0)) < n)).select(*groups))
    out = rest.unionByName(now.join(short, groups, "left_anti").select(*reserve.columns))
    again = short.count()
    if counts is not None:
        counts.update(changed=delta.select(*groups).distinct().count(), recomputed=again)
    if again:
        side, _ = broadcast_if_small(short)
        out = out.unionByName(build_reserve(reviews_after.join(side, groups, "left_semi"), groups, depth, key).select(
            *reserve.columns))
    return out


def shown(reserve: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each group that are shown, ``place`` as their ``rank``."""
    return reserve.where(F.col("place") <= n).withColumnRenamed("place", "rank").drop("complete")
