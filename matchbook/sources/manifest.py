"""Versions of a table kept as parts in folders of their own.

A version is one small table, ``<root>/manifest/version=<n>``, naming the folder of
every part.  Data is written first, into new folders; the manifest comes last, so
a run that dies in between leaves the version before it as the newest one, and a
reader never sees half a change.  Parts a change does not touch keep their folder.
Two writers that both follow version ``n`` cannot both write ``n + 1``: the second
one's manifest folder exists already, so it fails and has to start anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "part string, path string, filter string, info string, total int"


def commit(spark: SparkSession, root: str, version: int, entries: dict[str, tuple[str, str | None]], info: str) -> int:
    """Write ``version``: part -> (data folder, filter folder); one row a part."""
    rows = [(part, path, flt, info, len(entries)) for part, (path, flt) in sorted(entries.items())]
    rows = rows or [(None, None, None, info, 1)]
    (spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("errorifexists")
          .parquet(f"{root}/manifest/version={version}"))
    return version


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    try:
        rows = spark.read.schema(SCHEMA + ", version int").option("basePath", f"{root}/manifest").parquet(f"{root}/manifest")
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in (gone.getCondition() or ""):
            raise
        return []
    found = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return sorted(r["version"] for r in found.collect() if r["n"] == r["total"])


def read(spark: SparkSession, root: str, version: int | None = None):
    """(version, part -> (data folder, filter folder), info) of ``version``, by
    default the newest; ``(0, {}, None)`` when there is none."""
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if version not in known:
        if version:
            raise ValueError(f"no version {version} below {root}")
        return 0, {}, None
    rows = spark.read.schema(SCHEMA).parquet(f"{root}/manifest/version={version}").collect()
    return version, {r["part"]: (r["path"], r["filter"]) for r in rows if r["part"] is not None}, rows[0]["info"]
