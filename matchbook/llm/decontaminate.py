"""Benchmark windows inside documents, by Wu-Manber multi-pattern search.

The search runs over words.  All windows of one length share a table of
shifts: for a block of the last ``BLOCK`` words read, how far the search may
jump because no window has that block any nearer to its end.  Where the shift
is zero, the bucket of that end block and the window's first word select the
windows that are compared word by word.  A clean text is left in jumps of up to
eight words without comparing anything.

The tables of a benchmark block are broadcast; a block holds at most
``BLOCK_BYTES`` of item text.  A larger benchmark is cut into blocks of items,
each run over all documents, and the hits of equal texts are merged.

Defined cases: null texts and items have no words; an item of fewer than
``window`` words is one window, one of none has no window; a null item id
counts as the empty id; repeated rows are judged each; an empty benchmark
leaves every document clean; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, table, write_shared

WINDOW = 10
BLOCK = 3
BLOCK_BYTES = 2 << 20
HITS = "n_words long, _hits array<struct<start:int,len:int>>, _items array<string>"

# Bytes of words stay (A-Z lower-cased), all others become spaces.
_WORDS = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Windows of one length (in words) and the items that hold them."""

    def __init__(self, windows: dict[tuple, set], length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, dict[bytes, list]] = {}
        for words, items in windows.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            bucket = self.ends.setdefault(words[length - self.block:], {})
            bucket.setdefault(words[0], []).append((words, items))

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence, by start."""
        length, block, jump, shift, ends = self.length, self.block, self.jump, self.shift, self.ends
        at, n = length, len(words)
        while at <= n:
            key = tuple(words[at - block:at])
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            start = at - length
            for window, items in ends[key].get(words[start], ()):
                if tuple(words[start:at]) == window:
                    yield start, items
            at += 1


def build_tables(items: list[tuple[str, bytes]], window: int = WINDOW, block: int = BLOCK) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            by_length.setdefault(length, {}).setdefault(tuple(words[i:i + length]), set()).add(item)
    return [WuManber(windows, length, block) for length, windows in sorted(by_length.items())]


def search(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged hit intervals (start, length), and the items that occur."""
    found, items = [], set()
    for t in tables:
        for start, held in t.find(words):
            found.append((start, start + t.length))
            items |= held
    merged: list[list[int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b - a) for a, b in merged], items


def _scan(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]        # at most BLOCK_BYTES
    tables = docs.sparkSession.sparkContext.broadcast(build_tables(rows, window))

    def work(cols):
        out = [[], [], []]
        for text in cols[0]:
            words = words_of(text)
            hits, found = search(tables.value, words)
            for column, value in zip(out, (len(words), [{"start": a, "len": n} for a, n in hits], sorted(found)),
                                     strict=True):
                column.append(value)
        return out
    return add_by_arrow(docs, [text_col], HITS, work)


def _hit_words(hits: Column) -> Column:
    """Words inside the union of sorted intervals."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        return F.struct(F.greatest(acc["to"], end).alias("to"),
                        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], h["start"]))).alias("n"))
    return F.aggregate(F.array_sort(hits), zero, add, lambda acc: acc["n"])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items (sorted ids) and contaminated."""
    items = (benchmark.filter(F.col(item_text_col).isNotNull())
                      .select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                              F.col(item_text_col).alias("text")))
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        out = _scan(docs, items, text_col, window)
    else:
        key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        parts = None
        for b in range(blocks):
            mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
            part = write_shared(_scan(docs.select(text_col), mine, text_col, window).select(
                key.alias("_key"), *[c.split()[0] for c in ("n_words", "_hits", "_items")]), "benchmark-hits")
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("_key").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_set("_hits")).alias("_hits"),
            F.flatten(F.collect_set("_items")).alias("_items"))
        out = docs.drop("n_words").withColumn("_key", key).join(merged, "_key", "left").drop("_key")
    items_ = F.array_sort(F.array_distinct("_items"))
    hit = _hit_words(F.col("_hits"))
    return (out.withColumns({"n_hit": hit, "n_items": F.size(items_).cast("long"), "items": items_,
                             "contaminated": F.size("_hits") > 0}).drop("_hits", "_items"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS len,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT k, i, l.len, array_to_string(w[i:i + l.len - 1], ' ') AS win
  FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
       (SELECT DISTINCT len FROM bw) l
  WHERE i + l.len - 1 <= len(w)),
hit AS (SELECT dw.k, dw.i, dw.len, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.len = bw.len),
n AS (SELECT k, count(DISTINCT p) AS n_hit
      FROM (SELECT k, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT k, i, len FROM hit)) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT k, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit,
       coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.k = n.k LEFT JOIN it ON d.k = it.k
"""
