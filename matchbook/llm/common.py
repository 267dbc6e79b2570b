"""Shared helpers of the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.session import ensure_checkpoint_dir, ship_package

# A collected or broadcast side may hold at most this many bytes.
MAX_SIDE_BYTES = 64 << 20
BATCH_ROWS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: a
    cut of the lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_bytes: int = MAX_SIDE_BYTES) -> bool:
    """Whether the values of ``df`` hold at most ``max_bytes``: one aggregate,
    combined map-side (64 bytes a row, plus the lengths of text columns and 16
    bytes an array element)."""
    size = F.lit(64)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.coalesce(F.size(F.col(name)), F.lit(0)), F.lit(0))
    return (df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0) <= max_bytes


def broadcast_if_fits(df: DataFrame, max_bytes: int = MAX_SIDE_BYTES) -> DataFrame:
    """``df``, marked for broadcast only when its measured size is bounded."""
    return F.broadcast(df) if fits(df, max_bytes) else df


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id written as text is divisible by 5; a null
    id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in an Arrow batch of this session: a batch
    of whole texts is held twice in the executor and twice in its Python
    worker.  A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def add_by_arrow(df: DataFrame, read: list[str], add: str, work) -> DataFrame:
    """``df`` with further columns made in Arrow batches inside the tasks.

    ``work(columns)`` gets one list per column of ``read`` (texts as UTF-8
    bytes, null as None) and returns one list per column of the DDL ``add``;
    the other columns pass through.  Columns of ``df`` that ``add`` names are
    replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(add)
    kept = StructType([f for f in df.schema if f.name not in new.names])
    schema = StructType(kept.fields + new.fields)
    types, names = to_arrow_schema(new).types, schema.names
    keep = kept.names
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            cols = []
            for c in read:
                col = batch.column(c)
                if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                    col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
                cols.append(col.to_pylist())
            made = work(cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)
            del batch, cols, col, made

    return df.mapInArrow(run, schema)
