"""Jaccard join of five-word shingle sets by a token-group matrix.

Links are pairs of documents with 100 * |A & B| >= 75 * |A | B|; the result is
one row per document with its component.

1. Every text becomes its set size, a digest of the whole set, its ``SAMPLE``
   smallest shingle hashes and ``BUCKETS`` pairs of min-hashes.  Documents with
   equal sets are one representative from here on.
2. Two linked sets share at least ``NEED`` sampled hashes (see below), so a
   representative that shares fewer with all others together is alone.
3. The others are partitioned into groups of similar documents: the leader of a
   min-hash bucket is the document whose sample is shared most (the text that
   others were edited from, rather than an edit), and each document joins the
   leader it meets most often.  A group is cut by set size
   into blocks of about ``BLOCK`` documents or ``BLOCK_BYTES`` of text, whichever
   is less, each joined by the leader; blocks are compared completely in one
   task, so nothing grows with a hot group or with the length of its texts.
4. The matrix stores each group's union of sampled hashes.  A document and a
   group of which it is no part meet when their shared hashes can reach the
   need (of two groups, the smaller one's documents meet the larger group);
   within its own group a document outside the group's largest component meets
   all blocks.  Pairs that are already in one component are left out.
5. A block is opened for the documents that met it (in lots of ``LOT`` texts or
   ``LOT_BYTES``): the
   exact union of its sets bounds the overlap once more, then all its members
   are compared.  One link per document and component of the block is kept.

The sample: if J >= 3/4, each of the ``SAMPLE`` smallest hashes of the union of
both sets is in both with that share, so fewer than ``NEED`` common ones have a
chance below 1e-11 per link (exact when both sets fit into the sample).  Every
reported link is checked on complete sets of 64-bit shingle hashes.

Defined cases: null texts and texts without words have an empty set and are
linked with nothing (the component is the own id); a row with a null id gets a
null component and links nothing; rows that share an id are one document, so
their links are joined; repeated rows each get a row; an empty table gives an
empty result.  Ids are integers.  A text longer than a block's bytes is a part
of its own or stands beside few others: one task holds a text or two of any
length, and a hash for each of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, broadcast_if_fits, table, write_shared
from matchbook.llm.components import components
from matchbook.llm.shingles import _mix, shingle_set

THRESHOLD = (75, 100)
SAMPLE, NEED = 64, 22
BUCKETS = 8                    # pairs of min-hashes
BLOCK, BLOCK_BYTES = 128, 8 << 20       # texts, and bytes of texts, in a block
LOT, LOT_BYTES = 256, 8 << 20           # the same in a lot of queries
COMMON = 64                    # groups that may share a hash before it counts as common

_rng = np.random.Generator(np.random.PCG64(417))
_PERMUTE = _rng.integers(0, 1 << 63, 2 * BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _describe(cols):
    out = [[], [], [], []]
    for text in cols[0]:
        tokens = shingle_set(text)
        if len(tokens):
            least = np.array([_mix(tokens * p).min() for p in _PERMUTE], dtype=np.uint64)
            pairs = _mix(least[0::2] * np.uint64(3) + least[1::2] + np.arange(BUCKETS, dtype=np.uint64))
        else:
            pairs = tokens
        out[0].append(len(tokens))
        out[1].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
        out[2].append(tokens[:SAMPLE].view(np.int64))
        out[3].append(pairs.view(np.int64))
    return out


def links(a: int, b: int, both):
    """Whether sets of sizes a and b with ``both`` common shingles are linked."""
    num, den = THRESHOLD
    return den * both >= num * (a + b - both)


class OpenBlock:
    """The sets of a block, searched by shingle."""

    def __init__(self, ids, comps, sets: list[np.ndarray]):
        self.ids, self.comps = np.asarray(ids), np.asarray(comps)
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        self.who = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, tokens: np.ndarray) -> np.ndarray | None:
        """Shingles in common with every set; none if even the union of the
        block cannot reach the threshold."""
        first = np.searchsorted(self.tokens, tokens, "left")
        many = np.searchsorted(self.tokens, tokens, "right") - first
        num, den = THRESHOLD
        least = max(int(self.sizes.min()), -(-num * len(tokens) // den))
        if (num + den) * int((many > 0).sum()) < num * (len(tokens) + least):
            return None
        first, many = first[many > 0], many[many > 0]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(self.who[at], minlength=len(self.sizes))


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [shingle_set(t.encode()) for t in rows["text"]]


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of the links inside a block."""
    ids, sets = rows["rep"].to_numpy(), _sets(rows)
    block = OpenBlock(ids, ids, sets)
    label = np.arange(len(ids))
    for i, tokens in enumerate(sets):
        both = block.overlaps(tokens)
        if both is not None:
            linked = np.unique(label[links(len(tokens), block.sizes, both)])
            label[np.isin(label, linked)] = linked[0] if len(linked) else label[i]
    least = pd.Series(ids).groupby(label).transform("min").to_numpy()
    return pd.DataFrame({"a": ids, "b": least})[ids != least]


def _open_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the queries and the members of a block, one for each
    query and component."""
    members, queries = rows[~rows["query"]], rows[rows["query"]]
    found = []
    if len(members):
        block = OpenBlock(members["rep"], members["comp"], _sets(members))
        for rep, comp, tokens in zip(queries["rep"], queries["comp"], _sets(queries), strict=True):
            both = block.overlaps(tokens)
            if both is None:
                continue
            hit = np.flatnonzero(links(len(tokens), block.sizes, both) & (block.comps != comp))
            _, one = np.unique(block.comps[hit], return_index=True)
            found += [(rep, int(block.ids[j])) for j in hit[one]]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _need(n: Column) -> Column:
    return F.least(F.lit(NEED), F.ceil(n * THRESHOLD[0] / THRESHOLD[1]))


def _parts(rows: int, most_bytes: int) -> Column:
    """Into how many parts a group's rows are cut so that a part holds about
    ``rows`` of them and ``most_bytes`` of their texts."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("bytes") / most_bytes))


def _groups(active: DataFrame) -> DataFrame:
    """Rows (rep, n, bytes, leader, block) of representatives (rep, n, bytes,
    central, bands)."""
    spots = active.select("rep", "central", F.explode("bands").alias("band"))
    lead = (spots.groupBy("band").agg(
        F.max(F.struct("central", (-F.col("rep")).alias("rep"))).alias("top"), F.count(F.lit(1)).alias("many"))
        .filter("many > 1").select("band", (-F.col("top.rep")).alias("leader"), "top.central"))
    choice = (spots.select("rep", "band").join(lead, "band")
                   .groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("times"), F.max("central").alias("central"))
                   .groupBy("rep").agg(F.max(F.struct("times", "central", (-F.col("leader")).alias("no"))).alias("best"))
                   .select("rep", (-F.col("best.no")).alias("leader")))
    size_class = F.floor(F.log("n") / F.log(F.lit(4 / 3)))
    joined = (active.select("rep", "n", "bytes").join(choice, "rep", "left")
                    .withColumn("leader", F.coalesce("leader", "rep")).withColumn("size_class", size_class))
    joined = write_shared(joined, "jaccard-groups")
    # aggregates are written before they are joined back, so that a hot leader's
    # side of the join is a plain shuffle, which Spark can split
    many = write_shared(joined.groupBy("leader", "size_class").agg(
        _parts(BLOCK, BLOCK_BYTES).alias("blocks")), "jaccard-parts")
    part = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    return (joined.join(many, ["leader", "size_class"])
                  .select("rep", "n", "bytes", "leader", F.xxhash64("leader", "size_class", part).alias("block")))


def _met(tokens: DataFrame, placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (rep, comp, bytes, block): documents and the blocks they have to be
    compared with.  ``placed``: rep, n, bytes, leader, block, comp, apart (not in its
    group's largest component); ``blocks``: leader, block, least, most.

    Of two groups the documents of the smaller one meet the larger one, so a
    hot group is met by others and meets few itself.  Within a group, one of two
    documents of different components is apart.
    """
    num, den = THRESHOLD
    kinds = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("main"),
                                         (F.min("comp") == F.max("comp")).alias("pure"))
    kinds = write_shared(kinds, "jaccard-kinds")
    theirs = kinds.select(F.col("leader").alias("other"), F.col("size").alias("other_size"), "main", "pure")
    mine = tokens.join(placed.select("rep", "leader", "comp"), "rep")
    # most hashes stay within one group and go no further
    several = (mine.groupBy("token").agg(F.min("leader").alias("low"), F.max("leader").alias("high"))
                   .filter("low < high").select("token"))
    mine = write_shared(mine.join(several, "token", "left_semi"), "jaccard-several")
    matrix = mine.select("token", "leader").distinct()
    spread = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups"))
    mine = mine.join(kinds.select("leader", "size"), "leader").join(spread, "token")
    common = mine.filter(F.col("groups") > COMMON)
    many = common.groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
    need = _need(F.col("n"))
    meets = (((F.col("size") < F.col("other_size")) |
              ((F.col("size") == F.col("other_size")) & (F.col("leader") < F.col("other")))) &
             ~(F.col("pure") & (F.col("comp") == F.col("main"))))

    def groups_with(index: DataFrame) -> DataFrame:
        return index.select("token", F.col("leader").alias("other")).distinct().join(theirs, "other")

    rare = groups_with(matrix.join(spread.filter(F.col("groups") <= COMMON), "token"))
    shared = (mine.filter(F.col("groups") <= COMMON).join(rare, "token").filter(meets)
                  .groupBy("rep", "other").agg(F.count(F.lit(1)).alias("shared")))
    asked = (shared.join(placed.select("rep", "n"), "rep").join(many, "rep", "left")
                   .filter(F.col("shared") + F.coalesce("common", F.lit(0)) >= need).select("rep", "other"))
    # pairs without a rare hash in common: both hold as many common ones as are
    # needed, and one of the fewest-spread of them is shared
    full = many.join(placed.select("rep", "n"), "rep").filter(F.col("common") >= need)
    order = Window.partitionBy("rep").orderBy("groups", "token")
    held = common.join(full.select("rep", "common", "n"), "rep").withColumn("place", F.row_number().over(order))
    ahead = held.filter(F.col("place") <= F.col("common") - need + 1)
    asked = asked.unionByName(ahead.join(groups_with(held), "token").filter(meets).select("rep", "other")).distinct()
    own = placed.filter("apart").select("rep", F.col("leader").alias("other"))
    at = placed.select("rep", "n", "bytes", "comp", F.col("block").alias("own_block"))
    return (asked.unionByName(own).join(at, "rep")
                 .join(blocks.withColumnRenamed("leader", "other"), "other")
                 .filter((F.col("block") != F.col("own_block")) &
                         (F.col("most") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("least") * num))
                 .select("rep", "comp", "bytes", "block"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one per row of ``docs``."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = write_shared(add_by_arrow(
        base.withColumn("bytes", F.octet_length("text").cast("long")), ["text"], "n long, key binary, sample array<long>, bands array<long>", _describe)
        .drop("text"), "jaccard-sets")
    full = sets.filter("n > 0 and id is not null")
    reps = write_shared(full.groupBy("key").agg(
        F.min("id").alias("rep"), F.max("bytes").alias("bytes"), F.first("n").alias("n"), F.first("sample").alias("sample"),
        F.first("bands").alias("bands")), "jaccard-reps")
    of = full.select("id", "key").join(reps.select("key", "rep"), "key").select("id", "rep")
    # rows that share an id join their sets
    twice = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).filter("a <> _b")
    twice = of.join(twice.select("id", "a"), "id").select("a", F.col("rep").alias("b")).filter("a <> b")

    tokens = reps.select("rep", "n", F.explode("sample").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    tokens = write_shared(tokens.join(shared, "token"), "jaccard-tokens")
    central = (tokens.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("c"), F.round(F.sum(F.log("df")), 6).alias("logs"))
                     .filter(F.col("c") >= _need(F.col("n"))))
    active = write_shared(reps.drop("n", "sample").join(central, "rep").select(
        "rep", "n", "bytes", "bands", (F.col("logs") / F.least(F.col("n"), F.lit(SAMPLE))).alias("central")), "jaccard-active")
    groups = write_shared(_groups(active), "jaccard-blocks")
    texts = write_shared(base.join(broadcast_if_fits(groups.select(F.col("rep").alias("id"))), "id")
                             .select(F.col("id").alias("rep"), "text").distinct(), "jaccard-texts")

    members = groups.select("block", "rep").unionByName(
        groups.select("block", F.col("leader").alias("rep"))).distinct()
    inner = members.join(texts, "rep").groupBy("block").applyInPandas(_compare_block, "a long, b long")
    inner = write_shared(inner.unionByName(twice), "jaccard-inner")
    comps = components(inner)
    placed = groups.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn(
        "comp", F.coalesce("component", "rep")).drop("component")
    main = (placed.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("m"))
                  .groupBy("leader").agg(F.max(F.struct("m", "comp")).alias("top"))
                  .select("leader", F.col("top.comp").alias("main")))
    main = write_shared(main, "jaccard-main")
    placed = write_shared(placed.join(main, "leader").withColumn("apart", F.col("comp") != F.col("main")), "jaccard-placed")
    blocks = placed.groupBy("leader", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = write_shared(_met(tokens.select("token", "rep"), placed, blocks), "jaccard-met")
    lots = met.groupBy("block").agg(_parts(LOT, LOT_BYTES).cast("int").alias("lots"))
    queries = (met.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("rep"), F.col("lots")).cast("int"))
                  .select("block", "lot", "rep", "comp", F.lit(True).alias("query")))
    opened = (placed.select("block", "rep", "comp").join(lots, "block")
                    .withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
                    .select("block", "lot", "rep", "comp", F.lit(False).alias("query")))
    cross = (queries.unionByName(opened).join(texts, "rep")
                    .groupBy("block", "lot").applyInPandas(_open_block, "a long, b long"))
    all_edges = components(inner.unionByName(write_shared(cross, "jaccard-cross")))
    of_rep = reps.select("key", "rep").join(all_edges.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component"))
    own = sets.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull() & (F.col("n") > 0),
                                                                  F.col("key")).alias("key"))
    return own.join(of_rep, "key", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT k, doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, a.k AS ka, b.k AS kb, count(*) AS shared
         FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.k = ka JOIN n q ON q.k = kb
         WHERE x IS NOT NULL AND y IS NOT NULL AND 100 * shared >= 75 * (p.n + q.n - shared)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS id, y AS other FROM edge
          UNION SELECT r.id, e.y FROM reach r JOIN edge e ON e.x = r.other),
comp AS (SELECT id, min(other) AS smallest FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
       CASE WHEN n.n > 0 THEN least(w.doc_id, coalesce(comp.smallest, w.doc_id)) ELSE w.doc_id END AS component_id
FROM w LEFT JOIN n ON n.k = w.k LEFT JOIN comp ON comp.id = w.doc_id
"""
