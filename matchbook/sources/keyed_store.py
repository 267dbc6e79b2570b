"""A keyed table cut into key-hash partitions, merged part by part.

``merge_store`` reads, merges and rewrites only the partitions that hold a key of
the delta; all others are carried into the new version by reference (see
:mod:`matchbook.sources.manifest`).  A partition's rows are merged by
:func:`matchbook.operators.merge.upsert`, so a column the delta does not bring
keeps its values.

A store can keep Bloom filters beside each partition: ``filters`` maps a name to a
column, and the filter of that name holds the keys whose column is not NULL.  A
merge renews the filters of the partitions it rewrites, from the rows it wrote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchbook.operators.merge import upsert
from matchbook.operators.seen_filter import FILTER_SCHEMA, build_filters
from matchbook.session import cut_lineage
from matchbook.sources import manifest

DEFAULT_PARTS = 64


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write_parts(df: DataFrame, root: str, keys: list[str], parts: int, filters: dict) -> dict:
    """Write the partitions of ``df``; part -> (data folder, filter folder)."""
    spark = df.sparkSession
    run = uuid.uuid4().hex
    data, beside = f"{root}/data/run={run}", f"{root}/filters/run={run}"
    placed = df.withColumn("part", part_of(keys, parts))
    placed.repartition("part").write.partitionBy("part").parquet(data)
    written = spark.read.schema(StructType([*df.schema.fields, *StructType.fromDDL("part int").fields])).parquet(data)
    found = [r["part"] for r in written.select("part").distinct().collect()]          # at most `parts` numbers
    if filters:
        build_filters(written, keys, filters).repartition("part").write.partitionBy("part").parquet(beside)
    return {str(p): (f"{data}/part={p}", f"{beside}/part={p}" if filters else None) for p in found}


def create_store(df: DataFrame, root: str, keys, parts: int = DEFAULT_PARTS, filters: dict | None = None) -> int:
    """Write ``df`` (one row a key) as version 1 of a new store."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    info = {"keys": keys, "parts": parts, "filters": filters or {}, "schema": df.schema.json()}
    entries = _write_parts(df, root, keys, parts, filters or {})
    return manifest.commit(df.sparkSession, root, 1, entries, json.dumps(info))


def _open(spark: SparkSession, root: str, version: int | None):
    version, entries, info = manifest.read(spark, root, version)
    if not version:
        raise ValueError(f"no store below {root}")
    return version, entries, json.loads(info)


def store_info(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Keys, number of parts, filters and schema (JSON) of a store."""
    return _open(spark, root, version)[2]


def _read_paths(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, root: str, version: int | None = None, only_parts=None) -> DataFrame:
    """Rows of a version (default: the newest), of all or only some partitions.
    A column that a partition was written without is NULL there."""
    _, entries, info = _open(spark, root, version)
    paths = [path for part, (path, _) in entries.items() if only_parts is None or int(part) in only_parts]
    return _read_paths(spark, StructType.fromJson(json.loads(info["schema"])), paths)


def read_filters(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows (part, name, blocks, block, bits) of a version's Bloom filters."""
    _, entries, _ = _open(spark, root, version)
    paths = [flt for _, flt in entries.values() if flt]
    if not paths:
        return spark.createDataFrame([], f"{FILTER_SCHEMA}, part int")
    return spark.read.schema(f"{FILTER_SCHEMA}, part int").option("basePath", f"{root}/filters").parquet(*paths)


def merge_store(spark: SparkSession, root: str, delta: DataFrame, note: dict | None = None) -> int:
    """Merge ``delta`` (some columns for some keys) and return the new version;
    an empty delta changes nothing.  Partitions without a delta key are neither
    read nor written.  ``note`` joins the version's info (see :func:`store_info`)."""
    version, entries, info = _open(spark, root, None)
    keys, parts = info["keys"], info["parts"]
    schema = StructType.fromJson(json.loads(info["schema"]))
    # equal keys hash alike only when their types are equal
    delta = cut_lineage(delta.withColumns({k: F.col(k).cast(schema[k].dataType) for k in keys}))
    touched = {r["p"] for r in delta.select(part_of(keys, parts).alias("p")).distinct().collect()}   # at most `parts`
    if not touched:
        return version
    old = _read_paths(spark, schema, [path for part, (path, _) in entries.items() if int(part) in touched])
    merged = upsert(old, delta, keys)
    info.update(note or {}, schema=merged.schema.json())
    entries.update(_write_parts(merged, root, keys, parts, info["filters"]))
    return manifest.commit(spark, root, version + 1, entries, json.dumps(info))
