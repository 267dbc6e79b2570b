"""Corpus pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows below the shared checkpoint folder and reads them back as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import broadcast_if_fits, table, write_shared
from matchbook.llm.decontaminate import find_benchmark
from matchbook.llm.jaccard_join import jaccard_components
from matchbook.llm.mixing import mix
from matchbook.llm.secret_scan import all_spans, redacted, reject_from, scan
from matchbook.llm.toxicity import score, train


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns that are named like one of ``names`` renamed, and
    the selection that gives its columns back."""
    taken = {c: f"_docs_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(taken), [F.col(taken.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the machine learns from the labelled
    rows among ``docs``."""
    model = train(docs, table(spark, sf_dir, "labels"))
    rows, back = aside(docs, "_score")
    return score(rows, model, score_col="_score").filter("_score < 0.5").select(*back)


def own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``, null for documents without an id and different for any
    two others: the doc_id, or a new number for rows that share one.  Of those rows
    equal ones count once, and rows without a text go where one of the same id has
    a text."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("text").isNotNull()).alias("_any"))
    again = write_shared(ids.filter("n > 1").select("doc_id", "_any"), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn("_id", F.col("doc_id"))
    side = broadcast_if_fits(again)
    first = docs.agg(F.max("doc_id")).first()[0] + 1
    shared = docs.join(side, "doc_id").filter("text is not null or not _any").select(*docs.columns).distinct()
    # numbered once, in a written table: another run of a lost task must not deal other numbers
    shared = write_shared(shared.withColumn("_id", F.monotonically_increasing_id() + first), "repeated-rows")
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").alias("_id")).unionByName(shared)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id; documents
    without an id stay.  Rows that share an id are documents of their own: only
    those that are linked or equal go.  Texts are not shuffled while the ids to
    drop have a bounded size."""
    rows, back = aside(docs, "_id", "_any", "component_id", "n_shingles")
    rows = own_ids(rows)
    found = write_shared(jaccard_components(rows.select(F.col("_id").alias("doc_id"), "text")), "components")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(broadcast_if_fits(gone), "_id", "left_anti").select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    rows, back = aside(docs, "n_words", "n_hit", "n_items", "items", "contaminated", "_hits", "_items", "_key")
    found = find_benchmark(rows, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and ``n_chars`` renewed."""
    rows, back = aside(docs, "_base", "_found", "_tokens", "_wider", "_spans")
    scanned = write_shared(scan(rows), "scanned")
    out = scanned.withColumn("_spans", all_spans(reject_from(scanned)))
    out = out.withColumn("text", redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of the mix."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

# The machine, the join's components and the knapsack have no SQL form; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
