"""Scoring requests as a stream (R2): each micro-batch of requests runs the
scorer of the requested implementation for the users who asked, and appends
the ranked lists to a table partitioned by implementation (S10)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serve_requests(requests: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]],
                   out_path: str, reject_path: str | None = None) -> Callable:
    """Build a ``foreachBatch`` handler.

    ``scorers[implementation](users_df)`` returns the ranked rows for those
    users; every implementation has a scorer of its own.  Requests for a name
    that has none are not ranked; they are written to ``reject_path`` (by
    default ``<out_path>-rejects``) as rows (user_id, implementation).  Writes
    are keyed by ``epoch_id``: a replayed micro-batch overwrites its own
    partition instead of appending twice.
    """
    rejects = reject_path or f"{out_path.rstrip('/')}-rejects"

    def save(rows: DataFrame, epoch_id: int, path: str, *by: str) -> None:
        (rows.withColumn("epoch_id", F.lit(int(epoch_id)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*by, "epoch_id").parquet(path))

    def handler(batch: DataFrame, epoch_id: int) -> None:
        asked = batch.select("user_id", "implementation").distinct().persist()
        try:
            for name, scorer in scorers.items():
                users = asked.where(F.col("implementation") == name).select("user_id")
                save(scorer(users).withColumn("implementation", F.lit(name)), epoch_id, out_path, "implementation")
            known = F.coalesce(F.col("implementation").isin(list(scorers)), F.lit(False))
            save(asked.where(~known), epoch_id, rejects)
        finally:
            asked.unpersist()
    return handler
