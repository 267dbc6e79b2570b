"""Similarity between posting field vectors and user reference vectors
(F8, J3, A3), plus the block kernel that feeds per-user top-N directly.

Two physical forms of the same semantics:

* :func:`field_similarity` / :func:`job_scores` -- every (user, job, field)
  similarity as rows.  Use when the pairs themselves are the output.
* :func:`top_similar_jobs` -- scores are computed as dense matrix products
  inside (user block, job salt) cells, each task keeps an exact running top N
  per user, and only those leave the cell, so the ranking shuffle carries at
  most users x N x salts rows instead of users x jobs.  This is the ranking
  path; references, seen pairs and jobs all stay rows of the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.vectors import as_double, dot, norm
from matchbook.operators.embedding import FIELDS
from matchbook.operators.sizing import (DEFAULT_MAX_BROADCAST_BYTES, ELEMENT_BYTES, ROW_OVERHEAD_BYTES,
                                        fits_in_bytes)
from matchbook.sources.tables import spread_partitions

REF_BROADCAST_MAX_ROWS = 1_000_000  # ~ 250k users x 4 (field, lang) vectors
# The reference side is broadcast only when it also fits this many bytes
# (at dim 64 about 250k vectors, at dim 300 about 55k).
REF_BROADCAST_MAX_BYTES = DEFAULT_MAX_BROADCAST_BYTES
SALT_BUCKETS = 64
# Largest jobs x users score matrix the kernel builds at once (8M doubles,
# 64 MB per Python worker), whatever the Arrow batch size.
MAX_SCORE_CELLS = 8_000_000
# A task compacts its running top-N once it holds more than
# max(this, 4 x users x n) candidate rows.
COMPACT_MIN_ROWS = 100_000


def field_similarity(job_vecs: DataFrame, refs: DataFrame, job_key: str = "job_hash",
                     max_broadcast_rows: int = REF_BROADCAST_MAX_ROWS,
                     max_broadcast_bytes: int = REF_BROADCAST_MAX_BYTES) -> DataFrame:
    """Cosine similarity of each job field vector with each user's reference
    vector for the same (field, lang).

    Inputs: ``job_vecs(job_key, field, lang, vec)``, ``refs(user_id, field,
    lang, vec)``.  Each side's norm is computed once per vector, before the
    join, so a pair costs one dot product; a zero vector gives NULL.

    The join key has only a few values, so the reference side is broadcast
    when a size probe proves it small in rows and bytes.  Otherwise the
    pairs are cut into 2-D cells per key: users hashed into ``ub`` blocks
    (each within the byte budget) and jobs into ``js`` salts, with each job
    row sent to every user block and each reference row to every salt.  A
    cell's task then holds a bounded slice of the references, and the
    copies made (jobs x ``ub`` + references x ``js``) adapt to the sizes.
    """
    # the job side fans out into one row per user: spread it over the cores
    jobs = (spread_partitions(job_vecs.select(job_key, "field", "lang", as_double("vec").alias("vec")))
                    .withColumn("_n", norm("vec")))
    r = (refs.select("user_id", "field", "lang", as_double("vec").alias("ref_vec"))
             .withColumn("_rn", norm("ref_vec")))
    if fits_in_bytes(r, "ref_vec", max_broadcast_bytes, max_broadcast_rows):
        pairs = jobs.join(F.broadcast(r), ["field", "lang"])
    else:
        ub = _user_blocks(refs, max_broadcast_rows, max_broadcast_bytes)
        js = max(1, SALT_BUCKETS // ub)
        cells = ["field", "lang", "_salt", "_blk"]
        j2 = (jobs.withColumn("_salt", F.pmod(F.xxhash64(job_key), F.lit(js)))
                  .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(ub - 1)))))
        r2 = (r.withColumn("_blk", F.pmod(F.xxhash64("user_id"), F.lit(ub)))
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(js - 1)))))
        pairs = j2.join(r2, cells).drop("_salt", "_blk")
    return pairs.select("user_id", job_key, "field", "lang",
                        F.try_divide(dot("vec", "ref_vec"), F.col("_n") * F.col("_rn")).alias("similarity"))


def job_scores(field_sims: DataFrame, job_key: str = "job_hash", n_fields: int = len(FIELDS)) -> DataFrame:
    """Unweighted mean of the field similarities; NULL unless every field
    has a similarity (a missing field must not be silently skipped)."""
    return (field_sims.groupBy("user_id", job_key)
                      .agg(F.when(F.count("similarity") == n_fields, F.avg("similarity"))
                            .alias("score")))


# ------------------------------------------------------------ block kernel --

def wide_job_vectors(job_vecs: DataFrame, job_key: str = "job_hash", fields=FIELDS) -> DataFrame:
    """Long ``(job, field, lang, vec)`` -> one row per job with one vector
    column per field (NULL when the field is missing).  Of repeated vectors the
    smallest counts, whatever order the rows come in."""
    aggs = [F.min(F.when(F.col("field") == f, F.col("vec"))).alias(f"vec_{f}") for f in fields]
    return job_vecs.groupBy(job_key, "lang").agg(*aggs)


def _user_blocks(refs: DataFrame, max_rows: int, max_bytes: int) -> int:
    """How many user blocks keep each block's references within both
    limits (one aggregate job; a spare block absorbs hash imbalance)."""
    r = refs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec").cast("long")).alias("e")).first()
    n, e = int(r["n"]), int(r["e"] or 0)
    share = max(n / max_rows, (n * ROW_OVERHEAD_BYTES + e * ELEMENT_BYTES) / max_bytes)
    return 1 if share <= 1 else int(np.ceil(share)) + 1


def _ref_matrices(pdf, fields):
    """Unit-normalised reference matrices from a block's reference rows:
    ``(user_ids, {lang: {field: users x dim}})``.  Missing or zero vectors
    are NaN rows."""
    users = np.empty(pdf["user_id"].nunique(), dtype=object)
    users[:] = sorted(pdf["user_id"].unique().tolist())
    pos = {u: i for i, u in enumerate(users)}
    dim = max((len(v) for v in pdf["vec"] if v is not None), default=0)
    out = {}
    for lang, g in pdf.groupby("lang"):
        mats = {}
        for f in fields:
            m = np.full((len(users), dim), np.nan)
            for u, v in zip(g.loc[g.field == f, "user_id"], g.loc[g.field == f, "vec"]):
                if v is not None and len(v) == dim:
                    a = np.asarray(v, dtype=np.float64)
                    n = np.linalg.norm(a)
                    if n > 0:
                        m[pos[u]] = a / n
            mats[f] = m
        out[lang] = mats
    return users, out


def _unit_rows(col: pd.Series, dim: int) -> np.ndarray:
    """Arrow list column -> (rows x dim) unit vectors; NaN rows where the
    vector is missing, zero or of the wrong length.  Vectorised: one stack
    and one norm over the batch."""
    out = np.full((len(col), dim), np.nan)
    vals = col.to_numpy()
    ok = np.array([v is not None and len(v) == dim for v in vals], dtype=bool)
    if ok.any():
        m = np.stack([np.asarray(v, np.float64) for v in vals[ok]])
        n = np.linalg.norm(m, axis=1)
        good = n > 0
        idx = np.nonzero(ok)[0]
        out[idx[good]] = m[good] / n[good, None]
    return out


def _batch_leaders(keys: np.ndarray, scores: np.ndarray, excluded: np.ndarray, n: int):
    """Per user column: every job whose score ties or beats the n-th best,
    leaving out the ``excluded`` (job, user) cells.

    NaN scores rank last; they are kept only for users with fewer than n
    valid scores in the batch, and then only the n smallest keys."""
    rows_u, rows_j = [], []
    s = np.where(np.isnan(scores) | excluded, -np.inf, scores)
    if s.shape[0] <= n:
        ju, uu = np.nonzero(~excluded)
        return uu, ju
    kth = -np.partition(-s, n - 1, axis=0)[n - 1]  # n-th largest per user
    finite = np.isfinite(kth)
    mask = (s >= kth) & finite[None, :]
    ju, uu = np.nonzero(mask)
    rows_u.append(uu)
    rows_j.append(ju)
    for u in np.nonzero(~finite)[0]:          # fewer than n valid scores
        valid = np.nonzero(np.isfinite(s[:, u]))[0]
        nan_rows = np.nonzero(~np.isfinite(s[:, u]) & ~excluded[:, u])[0]
        take = nan_rows[np.argsort(keys[nan_rows], kind="stable")[: n - len(valid)]]
        sel = np.concatenate([valid, take])
        rows_u.append(np.full(len(sel), u))
        rows_j.append(sel)
    return np.concatenate(rows_u), np.concatenate(rows_j)


def _running_top(frames: list, n: int, job_key: str) -> pd.DataFrame:
    """Exact top ``n`` per user of the rows in ``frames`` by (score desc,
    NULL last, key asc) -- the final ranking's total order, so ties need not
    be carried.  ``score`` is float with NaN for NULL."""
    df = pd.concat(frames, ignore_index=True)
    rank_key = np.where(np.isnan(df["score"].to_numpy(np.float64)), np.inf, -df["score"].to_numpy(np.float64))
    df = df.assign(_o=rank_key).sort_values(["user_id", "_o", job_key], kind="mergesort")
    return df.groupby("user_id", sort=False).head(n).drop(columns="_o")


def top_similar_jobs(wide_jobs: DataFrame, refs: DataFrame, n: int, job_key: str = "job_hash",
                     fields=FIELDS, max_ref_rows: int = REF_BROADCAST_MAX_ROWS,
                     user_block: int = 4096,
                     max_ref_bytes: int = REF_BROADCAST_MAX_BYTES,
                     seen: DataFrame | None = None, job_salts: int | None = None) -> DataFrame:
    """Per-cell leaders ``(user_id, job_key, score)`` for a later exact
    per-user top-N (see :func:`matchbook.operators.ranking.top_n_per_group`).

    score = mean over ``fields`` of cosine(job field vector, user reference
    vector for that field and the job's language); NULL if any is missing.
    Pairs ``(user_id, job_key)`` of ``seen`` are left out.

    References, seen pairs and jobs meet as rows in (user block, job salt)
    cells: users are hashed into blocks whose references fit the limits, jobs
    into ``job_salts`` (default: the shuffle partitions over the blocks).  A
    cell's rows arrive sorted -- references, seen pairs, then jobs -- so its
    task holds one block's references and seen pairs and streams the jobs,
    keeping an exact running top ``n`` per user (compacted whenever it grows
    past a few times users x n rows).  Nothing passes through the driver.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    spark = wide_jobs.sparkSession
    blocks = _user_blocks(refs, max_ref_rows, max_ref_bytes)
    salts = job_salts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    key_type, user_type = wide_jobs.schema[job_key].dataType, refs.schema["user_id"].dataType
    vec_cols = [f"vec_{f}" for f in fields]

    def block(c):
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def salt(c):
        return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    no_vec = F.lit(None).cast("array<double>")
    jobs = wide_jobs.where(F.col(job_key).isNotNull()).select(
        every(blocks).alias("_blk"), salt(job_key).alias("_salt"), F.lit(2).alias("_kind"),
        F.col(job_key).alias("_job"), F.lit(None).cast(user_type).alias("_user"), F.lit(None).cast("string").alias("_field"),
        F.col("lang").alias("_lang"), no_vec.alias("_vec"), *[as_double(c).alias(c) for c in vec_cols])
    known = refs.where(F.col("user_id").isNotNull()).select(
        block("user_id").alias("_blk"), every(salts).alias("_salt"), F.lit(0).alias("_kind"),
        F.lit(None).cast(key_type).alias("_job"), F.col("user_id").alias("_user"), F.col("field").alias("_field"),
        F.col("lang").alias("_lang"), as_double("vec").alias("_vec"), *[no_vec.alias(c) for c in vec_cols])
    rows = jobs.unionByName(known)
    if seen is not None:
        rows = rows.unionByName(seen.select(
            block("user_id").alias("_blk"), salt(job_key).alias("_salt"), F.lit(1).alias("_kind"),
            F.col(job_key).cast(key_type).alias("_job"), F.col("user_id").cast(user_type).alias("_user"),
            F.lit(None).cast("string").alias("_field"), F.lit(None).cast("string").alias("_lang"), no_vec.alias("_vec"),
            *[no_vec.alias(c) for c in vec_cols]))
    cells = rows.repartition("_blk", "_salt").sortWithinPartitions("_blk", "_salt", "_kind")
    out = StructType([StructField("user_id", user_type), StructField(job_key, key_type),
                      *StructType.fromDDL("score double").fields])
    types = to_arrow_schema(out).types
    compact_min = COMPACT_MIN_ROWS

    def kernel(batches):
        at, refs_of, seen_of, ready, keep, kept = None, [], {}, None, [], 0

        def top():
            if not keep:
                return
            best = _running_top(keep, n, job_key)
            score = best["score"].to_numpy(np.float64)
            # NaN must leave as NULL: Spark would rank NaN above every number
            yield pa.RecordBatch.from_arrays(
                [pa.array(best["user_id"].tolist(), types[0]), pa.array(best[job_key].tolist(), types[1]),
                 pa.array(score, types[2], mask=np.isnan(score))], names=out.names)

        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("_blk", "_salt", "_kind")], axis=1)
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)]) if len(place) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(place)], strict=True):
                part, cell, kind = batch.slice(lo, hi - lo), tuple(place[lo][:2]), place[lo][2]
                if cell != at:
                    yield from top()
                    at, refs_of, seen_of, ready, keep, kept = cell, [], {}, None, [], 0
                if kind == 0:
                    refs_of.append(pd.DataFrame({
                        "user_id": pd.Series(part.column("_user").to_pylist(), dtype=object),
                        "field": part.column("_field").to_pylist(), "lang": part.column("_lang").to_pylist(),
                        "vec": part.column("_vec").to_pandas()}))
                elif kind == 1:
                    for j, u in zip(part.column("_job").to_pylist(), part.column("_user").to_pylist(), strict=True):
                        seen_of.setdefault(j, []).append(u)
                elif refs_of:
                    if ready is None:
                        users, mats = _ref_matrices(pd.concat(refs_of, ignore_index=True), fields)
                        ready = users, mats, {u: i for i, u in enumerate(users)}
                    found = _score_jobs(part, ready, seen_of, n, fields, vec_cols, user_block, job_key)
                    keep += found
                    kept += sum(len(f) for f in found)
                    if kept > max(compact_min, 4 * n * len(ready[0])):
                        keep = [_running_top(keep, n, job_key)]
                        kept = len(keep[0])
        yield from top()

    return cells.mapInArrow(kernel, out)


def _score_jobs(part, ready, seen_of: dict, n: int, fields, vec_cols, user_block: int, job_key: str) -> list:
    """Leaders among a run of job rows, as frames (user_id, job, score)."""
    users, mats, number = ready
    langs = np.array(part.column("_lang").to_pylist(), dtype=object)
    jobs = np.empty(len(langs), dtype=object)
    jobs[:] = part.column("_job").to_pylist()
    vecs = {c: part.column(c).to_pandas() for c in vec_cols}
    found = []
    for lang in {x for x in langs if x in mats}:
        pick = np.flatnonzero(langs == lang)
        keys = jobs[pick]
        per_field = [_unit_rows(vecs[c].iloc[pick], mats[lang][f].shape[1]) for f, c in zip(fields, vec_cols)]
        gone = [(i, number[u]) for i, k in enumerate(keys) for u in seen_of.get(k, ()) if u in number]
        step = max(1, min(user_block, MAX_SCORE_CELLS // max(1, len(keys))))
        for lo in range(0, len(users), step):
            hi = min(lo + step, len(users))
            score = sum(jm @ mats[lang][f][lo:hi].T for f, jm in zip(fields, per_field)) / len(fields)
            excluded = np.zeros(score.shape, dtype=bool)
            inside = [(i, u - lo) for i, u in gone if lo <= u < hi]
            if inside:
                excluded[tuple(np.array(inside).T)] = True
            uu, jj = _batch_leaders(keys, score, excluded, n)
            if len(uu):
                found.append(pd.DataFrame({"user_id": users[lo:hi][uu], job_key: keys[jj],
                                           "score": score[jj, uu].astype(np.float64)}))
    return found
