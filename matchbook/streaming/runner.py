"""Run a streaming query to completion into a table in the shared folder.

Sinks and stream checkpoints live under the session's reliable checkpoint
directory (``spark.checkpoint.dir``).  With a ``path`` given by the caller the
folders are stable, so a restarted query resumes from its offsets and state
after a driver loss; without one every run is a new query in a folder of its
own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from matchbook.session import ensure_checkpoint_dir


def stream_dirs(spark: SparkSession, name: str, path: str | None = None) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = path.rstrip("/") if path else f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{run}/out", f"{run}/state"


# Files per micro-batch: bounds a trigger's size (and so any one group's
# share of it) while keeping batches large enough to amortise planning.
DEFAULT_MAX_FILES_PER_TRIGGER = 64


def read_stream_table(spark: SparkSession, path: str, schema,
                      max_files_per_trigger: int = DEFAULT_MAX_FILES_PER_TRIGGER) -> DataFrame:
    """A file-based stream over ``path`` (directory or glob) with a fixed schema."""
    return (spark.readStream.schema(schema)
                 .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append",
                 partition_by=None, path: str | None = None) -> DataFrame:
    """Process everything available (``availableNow``), then read the sink."""
    spark = df.sparkSession
    out, state = stream_dirs(spark, name, path)
    w = df.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", state)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(out)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out)


def run_foreach_batch(df: DataFrame, name: str, handler, path: str | None = None) -> str:
    """Drive ``handler(batch_df, epoch_id)`` over all available input."""
    spark = df.sparkSession
    _, state = stream_dirs(spark, name, path)
    q = (df.writeStream.foreachBatch(handler).option("checkpointLocation", state)
           .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return state
