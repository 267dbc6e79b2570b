"""Parquet table access.  Reads are lazy; Catalyst prunes columns and
pushes filters into the scan (through the optional spread below)."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Spreading pays one shuffle; below this input size it is not worth it.
SPREAD_MIN_BYTES = 1 << 20

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _local_bytes(df: DataFrame) -> int | None:
    total = 0
    for f in df.inputFiles():
        u = urlparse(f)
        if u.scheme not in ("", "file"):
            return None
        total += os.path.getsize(u.path)
    return total


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Hash-spread a scan that arrives in fewer splits than there are cores.

    A table stored as one row group is scanned by one task, which leaves
    per-row CPU work (regexes, hashing) on a single core.  On a cluster the
    scan already has many splits and this is a no-op; only under-split
    input of a worthwhile size pays one shuffle.  Planning only, no job.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    size = _local_bytes(df)
    if size is None or size < SPREAD_MIN_BYTES:
        return df
    return df.repartition(target, key or df.columns[0])


def spread_partitions(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` in ``partitions`` partitions, or as it is when none are asked for.

    For inputs whose per-row work is large relative to their size (model
    hooks, a side that fans out into many pairs).  The caller says how many:
    asking a derived frame for its partition count would run its shuffles
    while the plan is only being built."""
    return df if partitions is None else df.repartition(partitions)


def read_table(spark: SparkSession, base_dir: str, name: str, spread_scan: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_scan else df
