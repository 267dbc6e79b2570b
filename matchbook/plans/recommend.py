"""The recommendation flow for many users at once.

    postings -semi- has field vectors
             -> similarity to each ready user's reference vectors, without the
                pairs that user was already scored on (per implementation)
             -> per-user top N -> joined back to posting info

Scores never materialise as users x jobs rows: the cell kernel emits only
per-cell leaders, then an exact window keeps N per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.embedding import ready_references, ref_readiness
from matchbook.operators.ranking import attach_info, top_n_per_group
from matchbook.operators.seen import check_implementation, drop_seen, seen_hashes
from matchbook.operators.similarity import top_similar_jobs, wide_job_vectors

DEFAULT_TOP_N = 10


def recommend(postings: DataFrame, job_vecs: DataFrame, refs: DataFrame, reviews: DataFrame,
              implementation: str = "FastText", n: int = DEFAULT_TOP_N,
              info_cols=("title", "company"), users: DataFrame | None = None) -> DataFrame:
    """Top ``n`` unseen postings per user by embedding similarity.

    ``postings(job_hash, ...)``, ``job_vecs(job_hash, field, lang, vec)``,
    ``refs(user_id, field, lang, vec)``, ``reviews([user_id, ]job_hash,
    llm_score, fasttext_score)``.  A posting that a user was already scored on
    is left out for that user only; a review store without ``user_id`` is
    everyone's.  Users whose reference vectors are incomplete and postings
    without vectors cannot be ranked: :func:`recommend_rejects` lists them.
    ``users`` (a DataFrame with ``user_id``) restricts the run to requested
    users.
    """
    check_implementation(implementation)
    ready_refs = ready_references(refs)
    if users is not None:
        ready_refs = ready_refs.join(users.select("user_id").distinct(), "user_id", "left_semi")
    seen = seen_hashes(reviews, implementation, users, distinct=False)    # membership only
    known = postings.select("job_hash")
    per_user = "user_id" in seen.columns
    if not per_user:
        known = drop_seen(known, seen)
    vecs = job_vecs.join(known, "job_hash", "left_semi")
    leaders = top_similar_jobs(wide_job_vectors(vecs), ready_refs, n, seen=seen if per_user else None)
    top = top_n_per_group(leaders, "user_id", "score", n, "job_hash")
    info = postings.select("job_hash", *info_cols)
    return (attach_info(top, info, "job_hash")
               .select("user_id", F.col("rank").cast("int").alias("rank"), "job_hash",
                       F.round("score", 6).alias("score"), *info_cols))


def recommend_rejects(postings: DataFrame, job_vecs: DataFrame, refs: DataFrame,
                      users: DataFrame | None = None) -> DataFrame:
    """What :func:`recommend` cannot rank, rows (user_id, job_hash, reason):
    postings without a stored vector (``no_vector``, for every user, so
    ``user_id`` is NULL) and users whose reference vectors are missing or
    incomplete (``not_ready``, ``job_hash`` NULL)."""
    key, user = postings.schema["job_hash"].dataType, refs.schema["user_id"].dataType
    bare = (postings.select("job_hash").join(job_vecs.where(F.col("vec").isNotNull()).select("job_hash"), "job_hash", "left_anti")
                    .select(F.lit(None).cast(user).alias("user_id"), "job_hash", F.lit("no_vector").alias("reason")))
    state = ref_readiness(refs).where(F.col("user_id").isNotNull())
    asked = state if users is None else users.select("user_id").distinct().join(state, "user_id", "left")
    late = asked.where(~F.coalesce("ready", F.lit(False)))
    return bare.unionByName(late.select(F.col("user_id").cast(user).alias("user_id"),
                                        F.lit(None).cast(key).alias("job_hash"), F.lit("not_ready").alias("reason")))
