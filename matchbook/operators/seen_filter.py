"""Bloom filters of the seen set (S3, J1): most candidates need no join.

A filter is blocked: a key's hash picks one block of ``BLOCK_BITS`` bits in its
partition's filter and ``BITS_SET`` bits inside it, so a candidate is tested with
one look-up of a 4 KB block.  "Absent" is certain; "perhaps" is confirmed by the
exact anti-join, whose shuffle then carries those candidates only.

Blocks are built with Spark's bitmap aggregate, combined map-side, at
``BITS_PER_KEY`` bits a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.operators.sizing import broadcast_if_small
from matchbook.session import cut_lineage

BLOCK_BITS = 32_768                 # of Spark's bitmap functions
BITS_SET = 4
BITS_PER_KEY = 12
FILTER_SCHEMA = "name string, blocks int, block int, bits binary"


def _block(keys: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *keys), blocks).cast("int")


def _places(keys: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(BLOCK_BITS)) for i in range(BITS_SET)]


def build_filters(rows: DataFrame, keys: list[str], filters: dict) -> DataFrame:
    """Rows (part, name, blocks, block, bits) for ``rows`` with their ``part``;
    ``filters`` maps a name to the column that must not be NULL."""
    named = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in sorted(filters.items())]))
    held = rows.select("part", *keys, named.alias("name")).where("name is not null")
    # partitions x names rows: a bounded side
    sizes = held.groupBy("part", "name").agg(
        F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / BLOCK_BITS).cast("int").alias("blocks"))
    bits = held.join(F.broadcast(sizes), ["part", "name"]).select(
        "part", "name", "blocks", _block(keys, F.col("blocks")).alias("block"),
        F.explode(F.array(*_places(keys))).alias("place"))
    return bits.groupBy("part", "name", "blocks", "block").agg(F.bitmap_construct_agg("place").alias("bits")).select(
        "name", "blocks", "block", "bits", "part")


def perhaps_seen(candidates: DataFrame, filters: DataFrame, name: str, keys: list[str], part: Column,
                 flag: str = "perhaps") -> DataFrame:
    """``candidates`` plus ``flag``: False where the key is certainly not in the
    filter.  Both filter sides are broadcast: the caller has checked their size."""
    mine = filters.where(F.col("name") == name)
    shape = F.broadcast(mine.select(F.col("part").alias("_part"), "blocks").distinct())
    bits = F.broadcast(mine.select(F.col("part").alias("_part"), F.col("block").alias("_block"), "bits"))
    placed = (candidates.withColumn("_part", part).join(shape, "_part", "left")
                        .withColumn("_block", _block(keys, F.col("blocks"))).join(bits, ["_part", "_block"], "left"))
    hit = F.lit(True)
    for place in _places(keys):
        byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (place % 8).cast("int") + 1)
        hit = hit & (byte.bitwiseAND(mask) != 0)
    return placed.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_part", "_block", "blocks", "bits")


def drop_seen_by_store(candidates: DataFrame, root: str, name: str) -> DataFrame:
    """Candidates whose key the store's filter column ``name`` does not hold:
    equal to the anti-join with those keys.

    The filters are broadcast when a probe proves them small; beyond that the
    exact anti-join runs alone.  Candidates that are perhaps seen meet the rows
    of their own partitions; the store's keys are shuffled only if those
    candidates are too many to broadcast.  ``candidates`` is read twice: cut its
    lineage first when it is costly.
    """
    from matchbook.sources.keyed_store import part_of, read_filters, read_store, store_info

    spark = candidates.sparkSession
    info = store_info(spark, root)
    keys, column = info["keys"], info["filters"][name]

    def held(parts=None):
        return read_store(spark, root, only_parts=parts).where(F.col(column).isNotNull()).select(*keys)

    filters, small = broadcast_if_small(read_filters(spark, root))
    if not small:
        return candidates.join(held(), keys, "left_anti")
    part = part_of(keys, info["parts"])
    flagged = perhaps_seen(candidates, filters, name, keys, part, "_perhaps")
    maybe = cut_lineage(flagged.where("_perhaps").select(*keys).distinct())
    parts = {r["p"] for r in maybe.select(part.alias("p")).distinct().collect()}      # at most the store's parts
    side, _ = broadcast_if_small(maybe)
    known = held(parts).join(side, keys, "left_semi")
    confirmed = flagged.where("_perhaps").join(known, keys, "left_anti")
    return flagged.where(~F.col("_perhaps")).unionByName(confirmed).drop("_perhaps")
