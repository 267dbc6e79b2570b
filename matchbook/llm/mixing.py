"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size (words).  A source takes whole passes of
itself while its target allows, and the rest of the budget is fitted by size
counts: a proportional share of every size first, then a bounded-knapsack
dynamic program over what is left.  Which documents of a size are taken
follows a seeded hash order, so reruns agree.

Scale: texts are read once for their sizes; only (id, source, size) rows move.
A size count is at most one row per (source, size), combined map-side.  The
seeded choice of ``n`` out of ``m`` documents splits a (source, size) group
into about sqrt(m) hash buckets, so neither a bucket nor the list of buckets
of a hot group grows with the group.  One knapsack runs per source, over its
distinct sizes only (bounded by the longest document).

Defined cases: null text has size 0 and is never taken (taken 0); a null
source is a source of its own, sorted last; repeated rows are separate
documents (which of two identical rows is taken makes no difference); an empty
table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.llm.common import table, write_shared
from matchbook.operators.ordering import with_global_index

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SEED = 17
# Budget, in words, handed to the dynamic program; the greedy pass before it
# only takes whole documents until the rest is at most this.
KNAPSACK_BUDGET = 1 << 16


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, num: int, den: int) -> DataFrame:
    """Targets of ``sources`` (weight, total): ``num/den`` of all totals shared
    by weight, a target stopping at twice its total and the excess going to the
    others by weight until none is above.  One small aggregate per round."""
    def exact(name):                            # products may exceed a long
        return F.col(name).cast("decimal(18,0)")

    budget = sources.agg(F.sum("total").alias("t")).first()["t"] or 0
    # a source is capped when weight * level >= 2 * total; the level only rises
    capped_below = (0, 1)                       # as a fraction: total / weight
    while True:
        n, d = capped_below
        is_capped = (exact("total") * F.lit(Decimal(d)) <= exact("weight") * F.lit(Decimal(n))
                     if n else F.lit(False))
        r = sources.agg(F.sum(F.when(is_capped, F.col("total")).otherwise(0)).alias("c"),
                        F.sum(F.when(is_capped, 0).otherwise(F.col("weight"))).alias("w")).first()
        free, weight = budget * num - 2 * (r["c"] or 0) * den, r["w"] or 0
        if not weight:
            return sources.withColumn("target", 2.0 * F.col("total"))
        # level = free / (den * weight); capped: 2 * total <= weight * level
        level = (free, 2 * den * weight)
        if level[0] * d <= n * level[1]:
            break
        capped_below = level
    return sources.withColumn("target", F.when(is_capped, 2.0 * F.col("total")).otherwise(
        F.lit(free).cast("double") * F.col("weight") / F.lit(float(den * weight))))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int,
               dp_budget: int = KNAPSACK_BUDGET) -> np.ndarray:
    """How many documents of each size to take so that the words come nearest
    below ``budget``: proportional share, whole documents from the largest size
    down until at most ``dp_budget`` words are left, then the dynamic program."""
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * int(budget) // total for c in counts], dtype=np.int64)
    rest = budget - int((sizes * take).sum())
    order = np.argsort(-sizes)
    for i in order:
        if rest <= dp_budget:
            break
        k = min(int(counts[i] - take[i]), (rest - dp_budget) // int(sizes[i]))
        take[i] += k
        rest -= k * int(sizes[i])
    rest = min(rest, int((sizes * (counts - take)).sum()))
    return take + knapsack(sizes, counts - take, rest)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the counts whose words are the largest sum within
    ``budget``.  ``by[s]`` is the bundle that first reached the sum ``s``."""
    take = np.zeros(len(sizes), dtype=np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)
    bundles = []
    for i in np.argsort(-sizes):
        size, left, many = int(sizes[i]), int(counts[i]), 1
        while size and left and size <= budget and not reached[budget]:
            many = min(many, left)
            step = size * many
            if step <= budget:
                new = np.zeros_like(reached)
                new[step:] = reached[:budget + 1 - step]
                new &= ~reached
                by[new] = len(bundles)
                reached |= new
                bundles.append((i, many, step))
            left -= many
            many *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, many, step = bundles[by[at]]
        take[i] += many
        at -= step
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), float(rows["target"].iloc[0])
    whole = min(2, int(target // total)) if total else 0
    part = fit_counts(sizes, counts, int(round(target)) - whole * total) if whole < 2 else 0 * counts
    return pd.DataFrame({"source_no": rows["source_no"], "size": sizes, "n": counts,
                         "whole": np.full(len(sizes), whole, dtype=np.int64), "part": part})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, num: int = 3, den: int = 2, seed: int = SEED) -> DataFrame:
    """Rows (id, size, source_size, target, taken), one per row of ``docs``."""
    sized = write_shared(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                    word_count(F.col(text_col)).alias("size")), "mix-sizes")
    hist = write_shared(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    sources = with_global_index(
        sources.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], "source_no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    sources = write_shared(sources.withColumn("weight", weight.cast("long")).drop("is_null"), "mix-sources")
    targets = water_fill(sources, num, den)
    plan = (hist.join(targets, hist["source"].eqNullSafe(targets["source"]))
                .select("source_no", "size", "n", "target")
                .groupBy("source_no").applyInPandas(
                    _fit_source, "source_no long, size long, n long, whole long, part long"))
    plan = (plan.join(targets, "source_no")
                .select("source", "source_no", "size", "n", "whole", "part",
                        F.col("total").alias("source_size"), "target"))
    plan = write_shared(plan, "mix-plan")
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))
    docs_ = (sized.join(plan.withColumnRenamed("size", "_size"),
                        (F.col("size") == F.col("_size")) & sized["source"].eqNullSafe(plan["source"]))
                  .select("id", "size", "source_no", "n", "whole", "part", "source_size", "target", key.alias("key")))
    # groups that are taken wholly or not at all need no order
    settled = (F.col("part") == 0) | (F.col("part") == F.col("n"))
    passes = F.col("whole") + F.when(F.col("part") == 0, 0).otherwise(1)
    done = docs_.filter(settled).withColumn("taken", F.col("size") * passes)
    bucket = F.pmod("key", F.greatest(F.ceil(F.sqrt("n")), F.lit(1)))
    open_ = docs_.filter(~settled).withColumn("bucket", bucket)
    before = Window.partitionBy("source_no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (open_.groupBy("source_no", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
                    .withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m"))
    within = Window.partitionBy("source_no", "size", "bucket").orderBy("key", "id")
    ranked = (open_.withColumn("rank", F.row_number().over(within))
                   .join(offsets, ["source_no", "size", "bucket"]))
    chosen = F.when(F.col("before") + F.col("rank") <= F.col("part"), 1).otherwise(0)
    ranked = ranked.withColumn("taken", F.col("size") * (F.col("whole") + chosen))
    cols = [F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return done.select(*cols).unionByName(ranked.select(*cols))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
