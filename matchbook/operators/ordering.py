"""Positional index over a total order, and page slicing.

``row_number() OVER (ORDER BY ...)`` without a partition runs in a single
task.  Here the order is established by a range-partitioned sort, each
partition numbers its own rows, and a per-partition offset (one row per
partition, so safe to broadcast) turns local numbers into global ones.
The sorted data is checkpointed first so that both passes see exactly the
same partitioning (range bounds come from sampling and are not stable
across re-executions).

Not used, and why: fixed sampled bounds applied by a nested-CASE binary
search would avoid the checkpoint, but the expression grows with the
number of ranges; code generation fails from about 1000 ranges and a
4000-range plan took minutes to compile, while a cluster needs ranges in
proportion to the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import cut_lineage

_PID_SHIFT = 33  # monotonically_increasing_id puts the partition id above bit 33


def with_global_index(df: DataFrame, order_cols, index_col: str = "row_index") -> DataFrame:
    """Add a 1-based, gap-free ``index_col`` following ``order_cols``."""
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    with_pid = ordered.withColumn("_pid", F.shiftright("_mid", _PID_SHIFT))
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _PID_SHIFT)
    return (with_pid.join(F.broadcast(offsets), "_pid")
                    .withColumn(index_col, (F.col("_off") + local + 1).cast("long"))
                    .drop("_pid", "_mid", "_off"))


def page_slice(df: DataFrame, order_cols, per_page: int, pages=None) -> DataFrame:
    """Number rows, then cut them into pages of ``per_page`` (1-based).

    ``pages`` optionally keeps only those page numbers (the API's ``page``
    parameter); by default every page is returned, i.e. the concatenation
    of all pages in order.
    """
    idx = with_global_index(df, order_cols, "row_index")
    out = (idx.withColumn("page", ((F.col("row_index") - 1) / per_page).cast("long") + 1)
              .withColumn("pos_in_page", ((F.col("row_index") - 1) % per_page) + 1))
    if pages is not None:
        out = out.filter(F.col("page").isin(list(pages)))
    return out
