"""Stored inverted index of postings.

``append_batch`` adds a landed batch: the (term, document) rows of its documents,
dealt by a hash of the term into bucket folders and sorted by term inside, so
that a file's statistics lead to a term's list.  A hot term's list is cut by a
hash of the document over ``FILES`` files of its bucket.  A batch is visible once
its manifest is written (:mod:`matchbook.sources.manifest`); appending a batch
again replaces it.

A keyword run reads only the buckets of the terms that somebody asks for.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions.text import tokenize
from matchbook.operators.sizing import broadcast_if_small
from matchbook.operators.textfilter import keyword_terms, pairs_of_hits
from matchbook.session import cut_lineage
from matchbook.sources import manifest

DEFAULT_BUCKETS = 256
FILES = 4                           # of a bucket and batch


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def append_batch(docs: DataFrame, root: str, batch: str, doc_key: str = "doc_id", text_col: str = "text",
                 buckets: int = DEFAULT_BUCKETS) -> int:
    """Add ``docs`` as ``batch`` and return the new version.  The number of
    buckets and the key's type are those of the first batch."""
    spark = docs.sparkSession
    version, entries, known = manifest.read(spark, root)
    info = json.loads(known) if known else {"buckets": buckets, "key": doc_key,
                                            "type": docs.schema[doc_key].dataType.simpleString()}
    path = f"{root}/terms/run={uuid.uuid4().hex}"
    hits = docs.select(F.col(doc_key).cast(info["type"]).alias(info["key"]),
                       F.explode(F.array_distinct(tokenize(text_col))).alias("term"))
    placed = hits.withColumn("bucket", bucket_of("term", info["buckets"]))
    (placed.repartition("bucket", F.pmod(F.xxhash64(info["key"]), F.lit(FILES)))
           .sortWithinPartitions("bucket", "term", info["key"])
           .write.partitionBy("bucket").parquet(path))
    entries[batch] = (path, None)
    return manifest.commit(spark, root, version + 1, entries, json.dumps(info))


def read_postings_of(spark: SparkSession, root: str, asked: DataFrame, version: int | None = None) -> DataFrame:
    """Rows (key, term) of the index for the terms of ``asked(term)``; only their
    buckets are read (a filter on the partition column)."""
    version, entries, known = manifest.read(spark, root, version)
    if not version:
        raise ValueError(f"no index below {root}")
    info = json.loads(known)
    key, schema = info["key"], f"{info['key']} {info['type']}, term string, bucket int"
    paths = [path for path, _ in entries.values()]
    if not paths:
        return spark.createDataFrame([], schema).drop("bucket")
    # at most `buckets` numbers
    wanted = [r["b"] for r in asked.select(bucket_of("term", info["buckets"]).alias("b")).distinct().collect()]
    stored = spark.read.schema(schema).option("basePath", f"{root}/terms").parquet(*paths)
    words, _ = broadcast_if_small(asked.select("term").distinct())
    return stored.where(F.col("bucket").isin(wanted)).join(words, "term", "left_semi").select(key, "term")


def indexed_keyword_matches(spark: SparkSession, root: str, keywords: DataFrame, version: int | None = None,
                            max_broadcast_terms: int = 5_000_000) -> DataFrame:
    """Pairs (user_id, key): any include term present, no exclude term, as
    :func:`matchbook.operators.textfilter.keyword_matches` finds them in the texts."""
    terms = cut_lineage(keyword_terms(keywords))
    hits = cut_lineage(read_postings_of(spark, root, terms, version))
    key = next(c for c in hits.columns if c != "term")
    return pairs_of_hits(hits, terms, key, max_broadcast_terms)
