"""MinHash fingerprints of five-word shingles.

A fingerprint holds, for each of ``N_HASHES`` universal hash functions
(multiply-add over 64 bits), the low 16 bits of the smallest hash over a text's
shingles, as hexadecimal text.  The share of equal places of two fingerprints
estimates the Jaccard similarity of the shingle sets.  ``near_pairs`` joins
documents in Spark on bands of the fingerprint and verifies the Jaccard
similarity on words: all members of a band bucket meet each other, in tiles of
bounded size; exact copies of a text meet through the smallest id of them.

``with_next`` pairs every document with the next one by descending id without
a single-task window: ids are cut into ranges at quantiles, an id (or the lack of
one) that fills several ranges by the hash of its texts as well; each range is
sorted in one partition, and a copy of the next range's first row travels along
as its neighbour.  Texts are shuffled once; only one row per range is copied.
Rows equal in id and text stay in one range, which streams through its task.
``near_text_classes`` is the band join as a query of its own.

Defined cases: a null text counts as empty; texts without words have the
fingerprint ``EMPTY``, which is alike (1.0) to itself and to nothing else; null
ids come last; rows of one id are ordered by their text's hash; the last row's
neighbour is the first (a single row's neighbour is itself); an empty table
gives an empty result; a task holds one Arrow batch of whole texts and in the band
join the texts of one tile, so a text of some MB costs a few times its size; in
the band join rows without words or id have no partner, a text's copies meet its
smallest id, rows of one id are compared each; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, bounded_batches, broadcast_if_fits, table, write_shared
from matchbook.llm.components import components
from matchbook.llm.shingles import shingle_hashes, shingle_set, word_hashes, words_in_common
from matchbook.llm.spans import let

N_HASHES = 128
BANDS, ROWS_PER_BAND = 32, 4
THRESHOLD = (75, 100)
TILE_ROWS = 128                # members of a bucket that meet as many others at once
SLACK = 0.25                   # an estimate so far below the threshold is off with a chance below 1e-9
EMPTY = "-"
WIDEST = 1 << 20               # more than the pieces of one id
CHUNK = 512                    # shingles hashed at once, so the matrix stays in the cache

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over the shingles."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), CHUNK):
        values = shingles[i:i + CHUNK, None] * _A
        values += _B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def fingerprint(text: bytes | None) -> str:
    words = word_hashes(text) if text else ()
    return signature(shingle_hashes(words)).astype(">u2").tobytes().hex() if len(words) else EMPTY


def likeness(a: str, b: str) -> float:
    if EMPTY in (a, b):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=">u2") for v in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``fingerprint``."""
    return add_by_arrow(docs, [text_col], "fingerprint string", lambda cols: [[fingerprint(t) for t in cols[0]]])


def _by_tile(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(tile, rows)`` for the rows of every ``tile``, which lie in one
    task, one tile in memory at a time; texts are bytes."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)
    bounded_batches(rows.sparkSession)
    rows = rows.repartition(F.col("tile")).sortWithinPartitions("tile")

    def batch_of(made):
        columns = list(zip(*made, strict=True)) if made else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                                          names=arrow.names)

    def run(batches):
        tile, held = None, []
        for batch in batches:
            cols = [c.cast(pa.binary()) if pa.types.is_string(c.type) and n == "text" else c
                    for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            made = []
            for row in zip(*[c.to_pylist() for c in cols], strict=True):
                row = dict(zip(batch.schema.names, row, strict=True))
                if row["tile"] != tile:
                    if held:
                        made += work(tile, held)
                    tile, held = row["tile"], []
                held.append(row)
            yield batch_of(made)
        if held:
            yield batch_of(work(tile, held))
    return rows.mapInArrow(run, out)


def _candidates(threshold: float):
    """Of a tile of fingerprints: rows (tile, id, smaller ids to verify) of the
    documents to verify.  A pair belongs to the first band that it shares."""
    least = (threshold - SLACK) * N_HASHES

    def work(tile, rows):
        band, _, x, y = tile.split(":")
        band = int(band)
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        block = np.array([r["block"] for r in rows])
        prints = np.array([np.frombuffer(bytes.fromhex(r["fingerprint"]), dtype=">u2") for r in rows])
        found: dict[int, set] = {}
        for i in range(len(ids)):
            same = prints == prints[i]
            bands = same.reshape(len(ids), BANDS, ROWS_PER_BAND).all(axis=2)
            good = (ids < ids[i]) & bands[:, band] & (bands.argmax(axis=1) == band) & (same.sum(axis=1) >= least)
            if x != y:
                good &= block != block[i]
            if good.any():
                mine = found.setdefault(int(ids[i]), set())
                for other in ids[good].tolist():
                    mine.add(other)
                    found.setdefault(other, set())
        return [(tile, ident, sorted(reps)) for ident, reps in found.items()]
    return work


def _verified(threshold: tuple[int, int]):
    """Of a tile of texts: the pairs that reach the threshold, found on shingle
    hashes and counted on words."""
    def linked(both, either):
        return both * threshold[1] >= either * threshold[0]

    def work(tile, rows):
        texts: dict[int, list] = {}
        for r in rows:
            texts.setdefault(r["id"], []).append((r["text"], shingle_set(r["text"])))
        out = []
        for ident, reps in {r["id"]: r["reps"] for r in rows}.items():
            for rep in reps:
                for a, x in texts[ident]:
                    for b, y in texts.get(rep, ()):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if linked(both, len(x) + len(y) - both):
                            both, either = words_in_common(a or b"", b or b"")
                            if linked(both, either):
                                out.append((ident, rep, both, either))
        return out
    return work


def _classes(threshold: tuple[int, int]):
    """Of a tile of texts: for every id with a link in it the smallest id that
    it reaches by the tile's links, and how many they are."""
    pairs_of = _verified(threshold)

    def work(tile, rows):
        root: dict[int, int] = {}
        links: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x
        for a, b, _, _ in pairs_of(tile, rows):
            links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
        return [(x, find(x), n) for x, n in links.items()]
    return work


def _candidate_tiles(texts: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): the fingerprints (id, copy, fingerprint) of all texts
    with words, the smallest id of each text, and the tiles of texts to verify."""
    prints = fingerprints(texts.withColumn("copy", F.sha2("text", 256)))
    prints = write_shared(prints.filter(F.col("fingerprint") != EMPTY).select("id", "copy", "fingerprint"), "prints")
    firsts = prints.groupBy("copy").agg(F.min("id").alias("id"), F.first("fingerprint").alias("fingerprint"))
    width = 4 * ROWS_PER_BAND
    bands = F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", b * width + 1, width)) for b in range(BANDS)])
    keys = firsts.select("id", F.explode(bands).alias("band"))
    sizes = keys.groupBy("band").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / TILE_ROWS).cast("int")
    # a member meets its own block and all others; the tile is named by the two
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (keys.join(sizes, "band").withColumn("blocks", blocks)
                   .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", other)
                   .select("id", "block", F.concat_ws(":", "band", F.least("block", "other"),
                                                      F.greatest("block", "other")).alias("tile"))
                   .join(firsts.select("id", "fingerprint"), "id"))
    wanted = _by_tile(members.select("tile", "id", "block", "fingerprint"), "tile string, id long, reps array<long>",
                      _candidates(threshold[0] / threshold[1]))
    wanted = write_shared(wanted, "wanted")
    # only texts with a candidate are shuffled where their ids fit a broadcast
    asked = texts.join(broadcast_if_fits(wanted.select("id").distinct()), "id", "left_semi")
    return prints, firsts, wanted.join(asked, "id").select("tile", "id", "reps", "text")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Rows (id, rep, both, either), ``rep`` the smaller id: the pairs of
    different texts that share a band and reach the threshold, with their verified
    intersection and union sizes; and every copy of a text with the smallest id
    of it.  A bucket is cut into blocks of about ``TILE_ROWS`` and every block
    meets every other, so memory is bounded and no pair is left out; the work
    in a bucket of different texts grows with its square."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    prints, firsts, tiles = _candidate_tiles(texts, threshold)
    pairs = _by_tile(tiles, "id long, rep long, both long, either long", _verified(threshold))

    def count(cols):
        found = [words_in_common(t or b"", t or b"") for t in cols[0]]
        return [[x for x, _ in found], [y for _, y in found]]
    # the text decides, not the id, in case an id has several
    same = texts.withColumn("copy", F.sha2("text", 256)).join(
        prints.join(firsts.select("copy", F.col("id").alias("rep")), "copy").filter("id <> rep")
              .select("id", "copy", "rep").distinct(), ["id", "copy"])
    same = add_by_arrow(same.select("id", "rep", "text"), ["text"], "both long, either long", count)
    return pairs.unionByName(same.select("id", "rep", "both", "either")).distinct()


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (binary search)."""
    cuts = F.array(*[F.lit(b).cast("double") for b in bounds])
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(cuts, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))
    rounds = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    return F.aggregate(rounds, zero, step, lambda acc: acc["lo"])


def _part(rows: DataFrame, n: int) -> Column:
    """Number of the range of (id, hash of the text) that a row lies in; about
    ``n`` ranges of equal size.  An id that fills several ranges is cut by the
    hash, as are the rows without id, which come first."""
    cuts = rows.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)
    bounds = sorted(set(cuts)) or [0.0]
    # above 2^53 a double stands for several ids, which must not be cut alike
    pieces = [cuts.count(b) if abs(b) < 2**53 else 1 for b in bounds]
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count("id").alias("with_id")).first()
    nulls = max(1, -(-n * (size["all"] - size["with_id"]) // max(size["all"], 1)))
    value = F.col("id").cast("double")

    def piece(count: Column) -> Column:
        share = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * count).cast("long")
        return F.least(F.greatest(share, F.lit(0)), count - 1)

    def within(place: Column) -> Column:
        many = F.coalesce(F.get(F.array(*[F.lit(k).cast("long") for k in pieces]), place - 1), F.lit(1).cast("long"))
        hot = (F.get(F.array(*[F.lit(b) for b in bounds]), place - 1) == value) & (many > 1)
        return place.cast("long") * WIDEST + F.when(hot, piece(many)).otherwise(many)
    return F.when(F.col("id").isNull(), piece(F.lit(nulls).cast("long")) - WIDEST).otherwise(
        let(_range_of(value, bounds), within))


def with_next(docs: DataFrame, id_col: str, text_col: str, work, schema: str) -> DataFrame:
    """``work(row, next_row)`` for every row and the next one by descending id;
    rows are (id, text bytes, memo dict).  ``work`` returns a tuple of ``schema``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("part", _part(rows, 8 * parts))
    order = F.struct("id", F.xxhash64("text").alias("hash"))
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max(order).alias("head")).collect())
    # the head of a range follows the last row of the next higher range; the
    # highest head follows the very last row
    following = [(heads[(i + 1) % len(heads)][0], head["id"], head["hash"]) for i, (_, head) in enumerate(heads)]
    ghosts = spark.createDataFrame(following, "to long, head_id long, head_hash long")
    ghosts = (rows.join(broadcast_if_fits(ghosts), F.col("id").eqNullSafe(F.col("head_id")) &
                        (F.xxhash64("text") == F.col("head_hash")))
                  .select("id", "text", F.col("to").alias("part"), F.lit(True).alias("ghost"))
                  .dropDuplicates(["part"]))
    every = (rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
                 .repartition(parts, "part")
                 .sortWithinPartitions("part", "ghost", F.desc_nulls_last("id"), F.xxhash64("text").desc()))
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        last = None                                     # (part, row) that waits for its next
        for batch in batches:
            made = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for key, ident, text, ghost in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(),
                                               texts, batch.column("ghost").to_pylist(), strict=True):
                row = (ident, text, {})
                if last and last[0] == key:
                    made.append(work(last[1], row))
                last = None if ghost else (key, row)
            columns = list(zip(*made, strict=True)) if made else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=arrow.names)
    return every.mapInArrow(run, out)


def _compare(row, following):
    """Fingerprints of a text and of its edit, whose last third is the next
    text's beginning, and their likenesses."""
    def own(r):
        if "print" not in r[2]:
            r[2]["print"] = fingerprint(r[1])
        return r[2]["print"]
    text, other = row[1].decode(), following[1].decode()
    k = len(text) // 3
    edited = (text[:len(text) - k] + other[:k]).encode()
    mine, changed = own(row), fingerprint(edited)
    return (row[0], len(text), hashlib.sha256(edited).hexdigest(), mine, changed,
            likeness(mine, changed), likeness(mine, own(following)))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs, "doc_id", "text", _compare,
                     "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (id_col, component_id, n_links): the smallest id
    reachable by links of ``near_pairs``, and the number of other texts that the id's
    text is linked with (each pair is verified in one tile, so the sums are exact).
    Tiles return a row per member, not per pair."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, firsts, tiles = _candidate_tiles(texts.filter("id is not null"), threshold)
    found = write_shared(_by_tile(tiles, "id long, rep long, links long", _classes(threshold)), "near-links")
    firsts = firsts.select("copy", F.col("id").alias("first"))
    of = write_shared(prints.select("id", "copy").join(firsts, "copy").select("id", "first").distinct(), "near-copies")
    edges = found.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(
        of.filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))).distinct()
    links = found.groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("links"))
    of = of.join(links, "first").groupBy("id").agg(F.sum("links").alias("links"))
    return (texts.select("id").join(components(write_shared(edges, "near-edges")), "id", "left").join(of, "id", "left")
                 .select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"),
                         F.coalesce("links", F.lit(0)).alias("n_links")))


def near_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join over all documents, as classes with verified links."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


NEAR_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, first, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, first, count(*) AS n FROM sh GROUP BY ALL),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
        FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
        WHERE a.doc_id = a.first AND b.doc_id = b.first GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edge AS (SELECT x, y FROM link UNION SELECT doc_id, first FROM n WHERE doc_id <> first
         UNION SELECT first, doc_id FROM n WHERE doc_id <> first),
reach AS (SELECT x AS id, y AS other FROM edge
          UNION SELECT r.id, e.y FROM reach r JOIN edge e ON e.x = r.other),
comp AS (SELECT id, min(other) AS smallest FROM reach GROUP BY id),
many AS (SELECT x, count(*) AS links FROM link GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(comp.smallest, d.doc_id)) AS component_id, coalesce(links, 0) AS n_links
FROM documents d LEFT JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN many ON many.x = n.first
"""
