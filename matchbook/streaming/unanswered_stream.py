"""Requests and their replies as one stream (R2): what was answered, and what
was not answered in time.

A left outer stream-stream join with watermarks on both sides and a time bound:
a reply belongs to a request of the same key if it comes at most ``within`` after
it.  A request leaves the state, as unanswered, once the watermark of the replies
has passed its bound; a reply leaves once no request before it can still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered_requests(requests: DataFrame, replies: DataFrame, key_cols, request_ts: str = "ts",
                      reply_ts: str = "reply_ts", within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows of ``requests`` with each reply in time (its columns NULL for a request
    that got none).  ``replies`` has the key columns and ``reply_ts``; its other
    columns must have names of their own."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    asked = requests.withColumn(request_ts, F.col(request_ts).cast("timestamp")).withWatermark(request_ts, delay)
    given = (replies.withColumn(reply_ts, F.col(reply_ts).cast("timestamp")).withWatermark(reply_ts, delay)
                    .withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    same = (F.col(reply_ts) >= F.col(request_ts)) & (F.col(reply_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return asked.join(given, same, "left_outer").drop(*[f"_r_{k}" for k in keys])
