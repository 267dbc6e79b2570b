"""Ingest against the stored identities (R3, W1): first posting wins, whenever it comes.

Every micro-batch is reduced to the first posting of each identity in source
order, compared with the store's rows of the same identities (only the key-hash
partitions that the batch touches are read) and merged:

* an identity the store does not have is ``new``;
* a posting that comes before the stored one in source order, though it arrived
  later, is a ``correction`` and replaces it;
* any other is a repeat and changes nothing.

The rows of an epoch go to its own partition of the change table before the store's
new version is committed, and that version carries the epoch.  A replayed epoch
that was committed is skipped; one that was not finds the same store as before and
writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.identity import dedup_first
from matchbook.session import cut_lineage
from matchbook.sources.keyed_store import merge_store, part_of, read_store, store_info


def store_ingest(root: str, out_path: str, order_cols) -> Callable:
    """A ``foreachBatch`` handler that keeps the store below ``root`` (one row an
    identity) and writes the changes, with ``kind``, below ``out_path``."""
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)

    def handler(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        info = store_info(spark, root)
        if info.get("epoch", -1) >= epoch_id:
            return
        keys = info["keys"]
        named = F.lit(True)
        for k in keys:
            named = named & F.col(k).isNotNull()
        first = cut_lineage(dedup_first(batch.where(named), keys, order))
        touched = {r["p"] for r in first.select(part_of(keys, info["parts"]).alias("p")).distinct().collect()}
        stored = read_store(spark, root, only_parts=touched).select(
            *keys, F.struct(*order).alias("_at"), F.lit(True).alias("_known"))
        met = first.join(stored, keys, "left")
        earlier = F.struct(*order) < F.col("_at")
        kind = F.when(F.col("_known").isNull(), "new").when(earlier, "correction")
        changes = cut_lineage(met.withColumn("kind", kind).where("kind is not null").drop("_at", "_known"))
        if changes.isEmpty():
            return
        (changes.withColumn("epoch_id", F.lit(int(epoch_id))).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("epoch_id").parquet(out_path))
        merge_store(spark, root, changes.drop("kind"), note={"epoch": int(epoch_id)})
    return handler
