"""Landed job-board pages.

Pages fetched from the job board are landed as JSON files under
``<root>/page=<n>/``; partition discovery turns the folder into the
``page`` column and ``posexplode`` keeps each posting's position in its
page, so ``(page, pos)`` is the source order used by keep-first dedup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.schemas import POSTING_PAGE


def land_pages(records: DataFrame, page_col: str, order_col: str, root: str) -> str:
    """Write posting records as the job board answers them: one JSON object
    ``{"results": [...]}`` per page below ``<root>-<unique>/page=<n>/``.  A page
    holds what the board returns at once, so it fits into one array."""
    rest = [c for c in records.columns if c not in (page_col, order_col)]
    rows = F.sort_array(F.collect_list(F.struct(order_col, F.struct(*rest).alias("r"))))
    path = f"{root}-{uuid.uuid4().hex}"
    (records.groupBy(F.col(page_col).alias("page")).agg(rows.alias("rows"))
            .select("page", F.transform("rows", lambda x: x["r"]).alias("results"))
            .write.partitionBy("page").json(path))
    return path


def read_posting_pages(spark: SparkSession, root: str, multiline: bool = True) -> DataFrame:
    pages = (spark.read.schema(POSTING_PAGE).option("multiLine", multiline)
                  .option("basePath", root).json(f"{root.rstrip('/')}/page=*"))
    if "page" not in pages.columns:
        raise ValueError(f"no page=<n> folders under {root}")
    return pages.select(F.col("page").cast("int").alias("page"),
                        F.posexplode("results").alias("pos", "r")).select("page", "pos", "r.*")
