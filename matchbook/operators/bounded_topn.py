"""Exact top N per user by cluster bounds (W2, J3 without users x postings).

Mean-of-cosines is one cosine: a posting's unit field vectors, joined end to end
and scaled to length 1, against the user's reference vectors of the same
language joined alike.  So angles obey the triangle inequality, and for a cluster
of postings with centre ``c`` and radius ``r`` (the largest angle of a member)

    score(user, any member)  <=  cos(max(0, angle(user, c) - r))

:func:`build_posting_index` clusters the postings once and stores them by
(language, cluster); :func:`search_top_n` opens each user's clusters best bound
first, a few per round, keeps the user's N best and stops when the bound of every
unopened cluster lies below the user's N-th score.  Scores are computed only for
opened (user, cluster) pairs; the users x clusters bounds are the only full
product.

A round is one job of cells: (language, cluster, chunk of its postings, block of
users) keeps a huge cluster (copies of one posting) or a cluster everybody opens
out of a single task.  The N-th score only rises and clusters are opened in the
order of their bounds, so what is open is always a prefix of that order and the
rounds need no state but the best lists, which are checkpointed each round.

Postings without a complete vector and languages a user has no reference in
rank last (NULL score, by key): their clusters have a NULL bound and are opened
only for users who have fewer than N scored postings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import as_double, unit
from matchbook.operators.embedding import FIELDS
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.similarity import MAX_SCORE_CELLS, _batch_leaders, _running_top, wide_job_vectors
from matchbook.operators.sizing import DEFAULT_MAX_BROADCAST_BYTES, ELEMENT_BYTES, ROW_OVERHEAD_BYTES, broadcast_if_small
from matchbook.session import cut_lineage
from matchbook.sources.snapshots import write_snapshot

# Centres are fitted on a bounded sample; every posting is assigned and counts
# towards its cluster's radius.
FIT_ROWS = 20_000
MAX_CLUSTERS = 1024                 # per language; the centres are broadcast
FIT_ROUNDS = 8
CHUNK_ROWS = 4096                   # postings of a cluster in one cell
FIRST_CLUSTERS = 4                  # opened in the first round, then four times as many
SLACK = 1e-9                        # of rounding in bounds and scores
NO_CLUSTER = -1                     # postings without a complete vector


def joined_vector(fields=FIELDS, prefix: str = "vec_"):
    """The unit vectors of all fields, end to end, length 1; NULL when one is missing or zero."""
    parts = [F.transform(unit(as_double(f"{prefix}{f}")), lambda x: x / float(np.sqrt(len(fields)))) for f in fields]
    return F.concat(*parts)


def _centres(sample: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means centres of unit rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def _matrix(column, dim: int) -> np.ndarray:
    """Arrow list column -> rows x dim; NaN rows for NULL or another length."""
    out = np.full((len(column), dim), np.nan)
    for i, v in enumerate(column.to_pandas()):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def build_posting_index(job_vecs: DataFrame, path: str, job_key: str = "job_hash", fields=FIELDS,
                        clusters: int | None = None) -> str:
    """Store ``job_vecs(job_key, field, lang, vec)`` as a clustered index below ``path``.

    ``postings/lang=/cluster=`` holds (job_key, chunk, vec), ``clusters`` one row
    per (lang, cluster) with centre, radius (angle), size and chunks.  ``clusters``
    per language default to the root of its postings.  Vectors whose length is
    not the longest one of the table count as missing.
    """
    spark = job_vecs.sparkSession
    wide = wide_job_vectors(job_vecs, job_key, fields).where(F.col(job_key).isNotNull() & F.col("lang").isNotNull())
    units = cut_lineage(wide.select(job_key, "lang", joined_vector(fields).alias("vec")))
    stats = {r["lang"]: r["n"] for r in units.where("vec is not null").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}                      # one row a language
    dim = units.agg(F.max(F.size("vec"))).first()[0] or 0
    centres = {}
    for lang, n in stats.items():
        share = min(1.0, FIT_ROWS / n)
        near = units.where((F.col("lang") == lang) & (F.size("vec") == dim) &
                           (F.pmod(F.xxhash64(job_key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        sample = np.array([r["vec"] for r in near.select("vec").orderBy(job_key).limit(2 * FIT_ROWS).collect()])
        if len(sample):
            k = min(clusters or int(np.sqrt(n)), MAX_CLUSTERS, len(sample))
            centres[lang] = _centres(sample, max(k, 1))
    shared = spark.sparkContext.broadcast(centres)                    # at most MAX_CLUSTERS vectors a language

    def assign(batches):
        import pyarrow as pa
        for batch in batches:
            cluster, angle = np.full(batch.num_rows, NO_CLUSTER, np.int32), np.full(batch.num_rows, np.nan)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            vecs = _matrix(batch.column("vec"), dim)
            for lang, c in shared.value.items():
                at = np.flatnonzero((langs == lang) & ~np.isnan(vecs[:, 0])) if dim else []
                if len(at):
                    cos = vecs[at] @ c.T
                    cluster[at] = np.argmax(cos, axis=1)
                    angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cluster), pa.array(angle, mask=np.isnan(angle))],
                names=[*batch.schema.names, "cluster", "angle"])

    kind = units.schema[job_key].dataType.simpleString()
    placed = cut_lineage(units.mapInArrow(assign, f"{job_key} {kind}, lang string, vec array<double>, cluster int, angle double"))
    sizes = placed.groupBy("lang", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK_ROWS).cast("int"))
    found = [(r["lang"], r["cluster"], r["n"], r["radius"], r["chunks"]) for r in sizes.collect()]  # one row a cluster
    rows = [(*r, [float(x) for x in centres[r[0]][r[1]]] if r[1] != NO_CLUSTER else None) for r in found]
    table = spark.createDataFrame(rows, "lang string, cluster int, n long, radius double, chunks int, centre array<double>")
    chunk = F.pmod(F.xxhash64(job_key), F.col("chunks")).cast("int")
    stored = placed.join(F.broadcast(table.select("lang", "cluster", "chunks")), ["lang", "cluster"])
    stored = stored.select(job_key, "vec", chunk.alias("chunk"), "lang", "cluster").repartition("lang", "cluster", "chunk")
    write_snapshot(stored, f"{path}/postings", partition_by=["lang", "cluster"])
    write_snapshot(table.coalesce(1), f"{path}/clusters")             # written last: the index is complete
    return path


def read_posting_index(spark: SparkSession, path: str, job_key_type: str = "bigint",
                       job_key: str = "job_hash") -> tuple[DataFrame, DataFrame]:
    """(postings, clusters) of a stored index."""
    postings = spark.read.schema(f"{job_key} {job_key_type}, vec array<double>, chunk int, lang string, cluster int").parquet(
        f"{path}/postings")
    return postings, spark.read.parquet(f"{path}/clusters")


def cluster_bounds(refs: DataFrame, clusters: DataFrame, fields=FIELDS) -> DataFrame:
    """Rows (user_id, lang, cluster, chunks, n, bound, place, vec): what a user can
    find in each cluster of the languages they have references for, ``place``
    numbering the user's clusters best bound first, NULL bounds last."""
    import pyarrow as pa

    spark = refs.sparkSession
    aggs = [F.min(F.when(F.col("field") == f, F.col("vec"))).alias(f"vec_{f}") for f in fields]
    users = refs.where(F.col("user_id").isNotNull()).groupBy("user_id", "lang").agg(*aggs).select(
        "user_id", "lang", joined_vector(fields).alias("vec"))
    table: dict = {}
    for r in clusters.collect():                                      # at most MAX_CLUSTERS + 1 rows a language
        table.setdefault(r["lang"], []).append((r["cluster"], r["chunks"], r["n"], r["radius"], r["centre"]))
    shared = spark.sparkContext.broadcast(table)
    kind = users.schema["user_id"].dataType.simpleString()
    schema = f"user_id {kind}, lang string, vec array<double>, cluster int, chunks int, n long, bound double"

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang, known in shared.value.items():
                at = np.flatnonzero(langs == lang)
                if not len(at):
                    continue
                dim = max((len(c) for *_, c in known if c is not None), default=0)
                vecs = _matrix(batch.column("vec").take(pa.array(at)), dim)
                centre = np.array([c if c is not None else [np.nan] * dim for *_, c in known]).reshape(len(known), dim)
                radius = np.array([r if r is not None else np.nan for *_, r, _ in known])
                angle = np.arccos(np.clip(vecs @ centre.T, -1, 1)) if dim else np.full((len(at), len(known)), np.nan)
                bound = np.cos(np.maximum(0, angle - radius))
                rows = pa.array(np.repeat(at, len(known)))
                flat = bound.ravel()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(rows) for c in ("user_id", "lang", "vec")],
                     pa.array(np.tile([k[0] for k in known], len(at)), pa.int32()),
                     pa.array(np.tile([k[1] for k in known], len(at)), pa.int32()),
                     pa.array(np.tile([k[2] for k in known], len(at)), pa.int64()),
                     pa.array(flat, mask=np.isnan(flat))],
                    names=["user_id", "lang", "vec", "cluster", "chunks", "n", "bound"])

    # a user's clusters are bounded in number, so the window is too
    order = Window.partitionBy("user_id").orderBy(F.col("bound").desc_nulls_last(), "lang", "cluster")
    return users.mapInArrow(run, schema).withColumn("place", F.row_number().over(order))


def _score_cells(opened: DataFrame, postings: DataFrame, seen: DataFrame | None, n: int, job_key: str,
                 blocks: int) -> DataFrame:
    """Leaders (user_id, job_key, score) of the opened (user, cluster) pairs.

    Users, seen pairs and postings meet as rows of (lang, cluster, chunk, user
    block) cells, sorted in that order; a cell's task holds its users and streams
    the postings."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    key_type, user_type = postings.schema[job_key].dataType, opened.schema["user_id"].dataType
    cell = ["lang", "cluster", "chunk", "_blk"]
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    asked = opened.withColumn("_blk", block)
    # at most clusters x blocks rows, so its size is bounded whatever the tables are
    cells = F.broadcast(asked.select("lang", "cluster", "_blk").distinct())
    jobs = postings.join(cells, ["lang", "cluster"]).select(
        *cell, F.lit(2).alias("_kind"), F.lit(None).cast(user_type).alias("_user"), F.col(job_key).alias("_job"), "vec")
    users = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *cell, F.lit(0).alias("_kind"), F.col("user_id").alias("_user"), F.lit(None).cast(key_type).alias("_job"), "vec")
    rows = users.unionByName(jobs)
    if seen is not None:
        rows = rows.unionByName(seen.withColumn("_blk", block).select(
            *cell, F.lit(1).alias("_kind"), F.col("user_id").alias("_user"), F.col(job_key).alias("_job"),
            F.lit(None).cast("array<double>").alias("vec")))
    rows = rows.repartition(*cell).sortWithinPartitions(*cell, "_kind")
    out = StructType([StructField("user_id", user_type), StructField(job_key, key_type),
                      *StructType.fromDDL("score double").fields])
    types = to_arrow_schema(out).types

    def kernel(batches):
        at, users, vecs, seen_of, refs, keep = None, [], [], {}, None, []

        def top():
            if keep:
                best = _running_top(keep, n, job_key)
                score = best["score"].to_numpy(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best["user_id"].tolist(), types[0]), pa.array(best[job_key].tolist(), types[1]),
                     pa.array(score, types[2], mask=np.isnan(score))], names=out.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = list(zip(*[batch.column(c).to_pylist() for c in (*cell, "_kind")], strict=True))
            starts = [i for i in range(len(place)) if not i or place[i] != place[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(place)], strict=True):
                part, here, kind = batch.slice(lo, hi - lo), place[lo][:-1], place[lo][-1]
                if here != at:
                    yield from top()
                    at, users, vecs, seen_of, refs, keep = here, [], [], {}, None, []
                if kind == 0:
                    users += part.column("_user").to_pylist()
                    vecs += part.column("vec").to_pandas().tolist()
                elif kind == 1:
                    for j, u in zip(part.column("_job").to_pylist(), part.column("_user").to_pylist(), strict=True):
                        seen_of.setdefault(j, set()).add(u)
                elif users:
                    if refs is None:
                        dim = max((len(v) for v in vecs if v is not None), default=1)
                        refs = np.full((len(users), dim), np.nan)
                        for i, v in enumerate(vecs):
                            if v is not None and len(v) == dim:
                                refs[i] = v
                        names = np.empty(len(users), dtype=object)
                        names[:] = users
                        number = {u: i for i, u in enumerate(users)}
                    found = _cell_leaders(part, refs, names, number, seen_of, n, job_key)
                    keep = [_running_top(keep + found, n, job_key)] if found else keep
        yield from top()

    return rows.mapInArrow(kernel, out)


def _cell_leaders(part, refs, names, number: dict, seen_of: dict, n: int, job_key: str) -> list:
    """Leaders among a run of posting rows, as frames (user_id, job, score)."""
    jobs = np.empty(part.num_rows, dtype=object)
    jobs[:] = part.column("_job").to_pylist()
    vecs = _matrix(part.column("vec"), refs.shape[1])
    gone = [(i, number[u]) for i, k in enumerate(jobs) for u in seen_of.get(k, ()) if u in number]
    step = max(1, MAX_SCORE_CELLS // max(1, len(jobs)))
    found = []
    for lo in range(0, len(names), step):
        score = vecs @ refs[lo:lo + step].T
        excluded = np.zeros(score.shape, dtype=bool)
        inside = [(i, u - lo) for i, u in gone if lo <= u < lo + step]
        if inside:
            excluded[tuple(np.array(inside).T)] = True
        uu, jj = _batch_leaders(jobs, score, excluded, n)
        if len(uu):
            found.append(pd.DataFrame({"user_id": names[lo:lo + step][uu], job_key: jobs[jj], "score": score[jj, uu]}))
    return found


def search_top_n(postings: DataFrame, clusters: DataFrame, refs: DataFrame, n: int, job_key: str = "job_hash",
                 seen: DataFrame | None = None, fields=FIELDS, counts: dict | None = None,
                 max_user_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """The ``n`` best postings per user, rows (user_id, job_key, score, rank),
    equal to ranking every pair.

    ``refs(user_id, field, lang, vec)``; pairs ``(user_id, job_key)`` of ``seen``
    are left out.  ``counts``, when given, gets ``pairs`` (scored) and ``rounds``.
    """
    bounds = cut_lineage(cluster_bounds(refs, clusters, fields))
    size = bounds.agg(F.countDistinct("user_id").alias("u"), F.max("place").alias("places"),
                      F.max(F.size("vec")).alias("dim")).first()
    blocks = -(-(size["u"] or 0) * ((size["dim"] or 0) * ELEMENT_BYTES + ROW_OVERHEAD_BYTES) // max_user_bytes) or 1
    if seen is not None:
        # where each seen posting lies; only pairs of users in the run
        mine = seen.select("user_id", job_key).join(refs.select("user_id").distinct(), "user_id", "left_semi")
        seen = cut_lineage(postings.select(job_key, "lang", "cluster", "chunk").join(mine, job_key))
    user_type, key_type = (bounds.schema["user_id"].dataType.simpleString(), postings.schema[job_key].dataType.simpleString())
    best = bounds.sparkSession.createDataFrame([], f"user_id {user_type}, {job_key} {key_type}, score double, rank int")
    opened_to, step, pairs, rounds = 0, FIRST_CLUSTERS, 0, 0
    while opened_to < (size["places"] or 0):
        # the N-th score of users who have N
        limit = best.where("score is not null").groupBy("user_id").agg(
            F.count(F.lit(1)).alias("have"), F.min("score").alias("least")).where(F.col("have") >= n).drop("have")
        side, _ = broadcast_if_small(limit)
        left = bounds.where(F.col("place") > opened_to).join(side, "user_id", "left").where(
            F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        chosen = left.where(F.col("place") <= opened_to + step)
        todo = left.agg(F.count(F.lit(1)).alias("left"),
                        F.sum(F.when(F.col("place") <= opened_to + step, F.col("n"))).alias("pairs")).first()
        if not todo["left"]:
            break
        opened_to, step = opened_to + step, step * 4
        if not todo["pairs"]:
            continue
        pairs, rounds = pairs + todo["pairs"], rounds + 1
        found = _score_cells(chosen.select("user_id", "lang", "cluster", "chunks", "vec"), postings, seen, n, job_key, blocks)
        merged = best.drop("rank").unionByName(found)
        best = cut_lineage(top_n_per_group(merged, "user_id", "score", n, job_key))
    if counts is not None:
        counts.update(pairs=pairs, rounds=rounds)
    return best
