"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import write_shared


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of every id in ``edges`` (a, b): the component is
    its smallest id.

    Each round points neighbours at the smallest neighbour (large star), then a
    node and its smaller neighbours at their smallest (small star); a hot node
    costs one partial minimum per input partition.  The table is written to the
    shared folder after each round, and rounds grow with the logarithm of the
    longest path.
    """
    def state(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def star(e: DataFrame) -> DataFrame:
        """(a, b) replaced by (b, smallest of a and its neighbours)."""
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return e.join(least, "a")

    now = write_shared(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = star(large)
        small = small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m"))
        now = write_shared(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
