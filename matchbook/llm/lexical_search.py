"""Ranked lexical search by NRA (no random access).

A first pass reads every text once and keeps, per document, its length and how
often each term of the items occurs in it (the terms of a block of items are
broadcast).  Spark counts documents, terms and document frequencies over the
whole table from there, so every weight is known before any list is read.

The lists are impact-sorted segments: a task cuts its documents into segments of
at most ``SEGMENT_POSTINGS`` postings (give or take a batch) and sorts each term's list by falling
impact.  For every item NRA reads the item's lists of a segment step by step, a
block of each list per step, never looking a document up: a document's lower
bound is the sum of its impacts read so far, its upper bound adds, for each list
it was not met in, that list's last impact read.  A document whose upper bound is
below the current K-th lower bound is out; when the sum of the last impacts is
below it too, no new document can come in.  Reading goes on until no interval of
a document that is still in is open (lists are at their end, or all of them met
it), so membership, ties and scores are exact.  The K-th score of the segments
before is the bound that the next segment starts with.  Spark then merges the
tasks' top lists.

A larger set of items is searched in blocks of ``BLOCK_BYTES`` of item text.

Defined cases: null texts and texts without a term are no documents of the
counts and match nothing; null items or items without a term have no result;
items (rows) that share an id are ranked each, as are documents that share one;
equal scores go by doc_id, nulls last, then by the text's hash; terms of weight 0
add nothing; empty tables give an empty result; other columns of the inputs play
no part, whatever their names; a very long text is one document in one segment.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.llm.common import bounded_batches, table, write_shared
from matchbook.llm.decontaminate import words_of

TOP = 50
SEGMENT_POSTINGS = 4_000_000
SEGMENT_DOCS = 50_000
MET_BYTES = 128 << 20              # of the table of documents met by an item's lists
FIRST_STEP = 64                    # postings of a list read in the first step; doubles each step
BLOCK_BYTES = 4 << 20
POSTINGS = "doc_id long, tie long, n long, terms array<int>, tfs array<int>"
HITS = "item int, doc_id long, tie long, score long"


def term_counts(text: bytes | None, numbers: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Terms of a text with repeats, and the known ones with their counts."""
    from collections import Counter
    words = words_of(text)
    known = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
    return len(words), [t for t, _ in known], [c for _, c in known]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Impact-sorted lists of some documents."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.n_docs = n_docs

    def top(self, terms: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the ``k`` highest scores of at least ``floor`` (ties of the
        k-th score included) and their scores."""
        terms = terms[self.start[terms + 1] > self.start[terms]]
        at, end = self.start[terms].copy(), self.start[terms + 1]
        lower = np.zeros(self.n_docs, dtype=np.int64)
        met = np.zeros((len(terms), self.n_docs), dtype=bool)
        inside = np.zeros(self.n_docs, dtype=bool)              # documents that are still in
        open_to_new, least, step = True, floor, FIRST_STEP
        last = self.impacts[at] if len(terms) else np.zeros(0, np.int64)
        while True:
            for i in np.flatnonzero(at < end):
                to = min(at[i] + step, end[i])
                docs, impacts = self.docs[at[i]:to], self.impacts[at[i]:to]
                if not open_to_new:
                    keep = inside[docs]
                    docs, impacts = docs[keep], impacts[keep]
                lower[docs] += impacts                          # a list holds a document once
                met[i, docs] = True
                if open_to_new:
                    inside[docs] = True
                at[i], last[i] = to, self.impacts[to - 1] if to < end[i] else 0
            step *= 2
            alive = np.flatnonzero(inside)
            if len(alive) >= k:
                best = lower[alive]
                least = max(least, int(np.partition(best, len(best) - k)[len(best) - k]))
            missing = last @ ~met[:, alive] if len(terms) else np.zeros(len(alive), np.int64)
            stay = lower[alive] + missing >= least
            inside[alive[~stay]] = False
            alive, missing = alive[stay], missing[stay]
            if open_to_new and int(last.sum()) < least:
                open_to_new = False
            if not open_to_new and not missing.any():
                return alive, lower[alive]


def _block(docs: DataFrame, items: list[tuple[int, bytes]], text_col: str, id_col: str, top: int) -> DataFrame | None:
    """Rows (item, doc_id, tie, score) of the top lists of one block of items."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    found = [(i, sorted(set(words_of(t)))) for i, t in items]
    numbers = {w: n for n, w in enumerate(sorted({w for _, ws in found for w in ws}))}
    item_terms = [(i, np.array([numbers[w] for w in ws], dtype=np.int64)) for i, ws in found if ws]
    known = spark.sparkContext.broadcast(numbers)                       # terms of at most BLOCK_BYTES of text
    bounded_batches(spark)
    kinds = to_arrow_schema(StructType.fromDDL(POSTINGS)).types
    hit_kinds = to_arrow_schema(StructType.fromDDL(HITS)).types
    most_docs = min(SEGMENT_DOCS, max(1, MET_BYTES // max((len(t) for _, t in item_terms), default=1)))

    def read(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [term_counts(t, known.value) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], kinds[3]), pa.array([r[2] for r in rows], kinds[4])],
                names=["doc_id", "tie", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"),
                        F.col(text_col).alias("text"))
    postings = write_shared(texts.mapInArrow(read, POSTINGS).filter("n > 0"), "search-postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r["term"]: r["count"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(numbers))], dtype=np.int64)
    model = spark.sparkContext.broadcast((weights, item_terms))         # at most BLOCK_BYTES of terms

    def search(batches):
        weights, item_terms = model.value
        best = {i: [] for i, _ in item_terms}                           # (-score, id is null, id, tie)
        pending, held = [], 0

        def close():
            """Search the pending documents as one segment."""
            ids = pa.concat_arrays([p[0] for p in pending]).to_pylist()
            ties = np.concatenate([p[1] for p in pending])
            doc, term, impact = (np.concatenate([p[c] for p in pending]) for c in (2, 3, 4))
            segment = Segment(doc, term, impact, len(ids), len(weights))
            for item, terms in item_terms:
                had = best[item]
                got, scores = segment.top(terms, top, -had[-1][0] if len(had) == top else 1)
                for d, s in zip(got.tolist(), scores.tolist(), strict=True):
                    had.append((-s, ids[d] is None, ids[d] or 0, int(ties[d])))
                had.sort()
                del had[top:]

        base = 0
        for batch in (b.slice(at, most_docs) for b in batches for at in range(0, b.num_rows, most_docs)):
            if base + batch.num_rows > most_docs or held >= SEGMENT_POSTINGS:
                close()
                pending, held, base = [], 0, 0
            terms, tfs = batch.column("terms"), batch.column("tfs")
            n = batch.column("n").to_numpy()
            # the whole-number steps as the contract states them
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            doc = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
            tf = tfs.flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy().astype(np.int64)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            use = impact > 0
            pending.append((batch.column("doc_id"), batch.column("tie").to_numpy(), doc[use] + base, term[use], impact[use]))
            base += len(n)
            held += int(use.sum())
        if pending:
            close()
        rows = [(item, None if null else d, tie, -s) for item, had in best.items() for s, null, d, tie in had]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate(hit_kinds)],
            names=["item", "doc_id", "tie", "score"])

    return postings.mapInArrow(search, HITS)


def rank(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id",
         item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    numbered = write_shared(
        items.filter(F.col(item_text_col).isNotNull())
             .select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
             .withColumn("size", F.octet_length("text").cast("long") + 16)
             .withColumn("row", F.monotonically_increasing_id()), "search-items")
    total = numbered.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        rows = part.select("item_id", "row", "text").collect()          # about block_bytes
        hits = _block(docs, [(i, r["text"].encode()) for i, r in enumerate(rows)], text_col, id_col, top)
        if hits is None:
            continue
        names = spark.createDataFrame([(i, r["item_id"], r["row"]) for i, r in enumerate(rows)],
                                      f"item int, item_id {dict(numbered.dtypes)['item_id']}, row long")
        named = hits.join(F.broadcast(names), "item").drop("item")
        out = named if out is None else out.unionByName(named)
    if out is None:
        kind = dict(numbered.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
               .select("item_id", "rank", "doc_id", "score"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT k, doc_id, len(w) AS n, w FROM (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0),
i AS (
  SELECT DISTINCT r, item_id, unnest(w) AS term FROM (
    SELECT row_number() OVER () AS r, item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
p AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY k, term),
t AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, c GROUP BY term, nd),
m AS (SELECT k, doc_id, 100 - 50 + ((50 * n * nd) // l) AS m FROM d, c),
s AS (
  SELECT i.r, i.item_id, m.k, m.doc_id, CAST(sum(t.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
  FROM i JOIN p ON i.term = p.term JOIN t ON t.term = p.term JOIN m ON m.k = p.k
  GROUP BY i.r, i.item_id, m.k, m.doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
