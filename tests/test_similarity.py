import numpy as np
from pyspark.sql import functions as F

from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.similarity import (field_similarity, job_scores, top_similar_jobs,
                                            wide_job_vectors)


def _data(spark, n_jobs=300, n_users=7, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    jobs = []
    for j in range(n_jobs):
        lang = "FR" if j % 2 else "EN"
        for f in ("description", "title"):
            v = rng.integers(-2, 3, size=dim).astype(float).tolist()   # small ints -> exact ties
            if j % 53 == 0 and f == "title":
                v = [0.0] * dim                                        # zero vector -> NULL score
            jobs.append((f"j{j:04d}", f, lang, v))
    refs = [(u, f, l, rng.normal(size=dim).tolist())
            for u in range(n_users) for f in ("description", "title") for l in ("FR", "EN")]
    jv = spark.createDataFrame(jobs, "job_hash string, field string, lang string, vec array<double>")
    rv = spark.createDataFrame(refs, "user_id int, field string, lang string, vec array<double>")
    return jv, rv


def test_kernel_top_n_equals_join_top_n(spark):
    jv, rv = _data(spark)
    n = 12
    join_path = top_n_per_group(job_scores(field_similarity(jv, rv)), "user_id", "score", n, "job_hash")
    kernel = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    a = sorted((r.user_id, r.rank, r.job_hash, round(r.score, 9) if r.score is not None else None)
               for r in join_path.collect())
    b = sorted((r.user_id, r.rank, r.job_hash, round(r.score, 9) if r.score is not None else None)
               for r in kernel.collect())
    assert a == b


def test_kernel_null_scores_rank_last(spark):
    jv, rv = _data(spark, n_jobs=20)
    n = 25                                   # more than the jobs: NULL scores must appear, last
    ranked = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    rows = ranked.where("user_id = 0").orderBy("rank").collect()
    assert len(rows) == 20
    nulls = [r.rank for r in rows if r.score is None]
    assert nulls and min(nulls) > max(r.rank for r in rows if r.score is not None)


def test_field_similarity_salted_path(spark):
    jv, rv = _data(spark, n_jobs=40, n_users=3)
    a = field_similarity(jv, rv)                              # broadcast path
    b = field_similarity(jv, rv, max_broadcast_rows=1)        # salted shuffle path
    key = lambda r: (r.user_id, r.job_hash, r.field)
    ra = {key(r): r.similarity for r in a.collect()}
    rb = {key(r): r.similarity for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        assert (ra[k] is None and rb[k] is None) or abs(ra[k] - rb[k]) < 1e-12


def test_kernel_user_blocks(spark):
    jv, rv = _data(spark, n_jobs=60, n_users=9)
    n = 5
    one = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    blocked = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n, max_ref_rows=10),
                              "user_id", "score", n, "job_hash")
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    assert sorted(map(key, one.collect())) == sorted(map(key, blocked.collect()))


def test_byte_budget_forces_the_large_plans(spark):
    # 9 users x 4 vectors of 6 doubles: a 1 kB budget admits ~2 users'
    # references, so the join salts and the kernel splits users into blocks.
    from matchbook.operators.sizing import fits_in_bytes
    jv, rv = _data(spark, n_jobs=60, n_users=9)
    assert fits_in_bytes(rv, "vec", max_bytes=1 << 20)
    assert not fits_in_bytes(rv, "vec", max_bytes=1000)
    n = 5
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    one = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    blocked = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n, max_ref_bytes=1000),
                              "user_id", "score", n, "job_hash")
    assert sorted(map(key, one.collect())) == sorted(map(key, blocked.collect()))
    a = field_similarity(jv, rv)
    b = field_similarity(jv, rv, max_broadcast_bytes=1000)
    assert "BroadcastHashJoin" not in b._jdf.queryExecution().executedPlan().toString()
    ka = sorted((r.user_id, r.job_hash, r.field, None if r.similarity is None else round(r.similarity, 9))
                for r in a.collect())
    kb = sorted((r.user_id, r.job_hash, r.field, None if r.similarity is None else round(r.similarity, 9))
                for r in b.collect())
    assert ka == kb


def test_kernel_small_user_blocks_same_ranking(spark):
    jv, rv = _data(spark, n_jobs=80, n_users=9)
    n = 6
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    full = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    tiny = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n, user_block=2),
                           "user_id", "score", n, "job_hash")
    assert sorted(map(key, full.collect())) == sorted(map(key, tiny.collect()))


def test_kernel_running_top_across_many_batches(spark, monkeypatch):
    # tiny Arrow batches and a tiny compaction threshold: every task folds
    # many batches and compacts repeatedly; the ranking must not change
    import matchbook.operators.similarity as sim
    jv, rv = _data(spark, n_jobs=300, n_users=7)
    n = 9
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    want = top_n_per_group(job_scores(field_similarity(jv, rv)), "user_id", "score", n, "job_hash")
    monkeypatch.setattr(sim, "COMPACT_MIN_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n,
                              "job_hash")
        got_rows = sorted(map(key, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got_rows == sorted(map(key, want.collect()))


def test_kernel_ignores_jobs_without_a_key(spark):
    jv, rv = _data(spark, n_jobs=30, n_users=3)
    nulls = spark.createDataFrame([(None, "title", "FR", [1.0] * 6), (None, "description", "FR", [1.0] * 6)],
                                  jv.schema)
    n = 5
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    a = top_n_per_group(top_similar_jobs(wide_job_vectors(jv), rv, n), "user_id", "score", n, "job_hash")
    b = top_n_per_group(top_similar_jobs(wide_job_vectors(jv.unionByName(nulls)), rv, n),
                        "user_id", "score", n, "job_hash")
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
