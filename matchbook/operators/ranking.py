"""Top-N per user and global top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(score_col: str, tie_cols):
    ties = [tie_cols] if isinstance(tie_cols, str) else list(tie_cols or [])
    return [F.col(score_col).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def top_n_per_group(df: DataFrame, group_cols, score_col: str, n: int, tie_cols=None,
                    rank_col: str = "rank") -> DataFrame:
    """The ``n`` best rows per group, highest score first, NULL scores last,
    ties broken by ``tie_cols``.

    ``row_number() <= n`` directly over the window lets Catalyst insert a
    partial ``WindowGroupLimit`` before the shuffle, so at most ``n`` rows
    per group per input partition are shuffled even for a hot group.
    """
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    w = Window.partitionBy(*groups).orderBy(*_order(score_col, tie_cols))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def attach_info(ranked: DataFrame, info: DataFrame, key: str = "job_hash",
                max_rows: int | None = None) -> DataFrame:
    """Join ranked lists (at most groups x n rows) to a large info table.

    The lists are materialised once with a reliable checkpoint (the work
    behind them survives executor loss) and broadcast to the info scan when
    a size probe proves them small, so the info table is not shuffled
    for the lookup; otherwise both sides shuffle on ``key``."""
    from matchbook.operators.sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_small
    from matchbook.session import cut_lineage
    limit = DEFAULT_MAX_BROADCAST_ROWS if max_rows is None else max_rows
    side, _ = broadcast_if_small(cut_lineage(ranked), limit)
    return side.join(info, key)


def top_n(df: DataFrame, score_col: str, n: int, tie_cols=None) -> DataFrame:
    """Global top ``n`` (``TakeOrderedAndProject``: per-partition top-n,
    then a final merge of n x partitions rows)."""
    return df.orderBy(*_order(score_col, tie_cols)).limit(n)


def top_jobs(reviews: DataFrame, job_info: DataFrame, implementation: str, n: int = 10,
             info_cols=("title", "company", "url")) -> DataFrame:
    """Top ``n`` reviewed postings per user for one implementation, with
    their posting info (S9 = W2 over ai_review, then J4)."""
    from matchbook.operators.seen import SCORE_COLUMN, check_implementation
    score = SCORE_COLUMN[check_implementation(implementation)]
    ranked = top_n_per_group(reviews.where(F.col(score).isNotNull()), "user_id", score, n, "job_hash")
    cols = [c for c in info_cols if c in job_info.columns]
    return attach_info(ranked, job_info.select("job_hash", *cols), "job_hash")
