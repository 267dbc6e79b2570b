import numpy as np
from pyspark.sql import functions as F

from matchbook.operators import bounded_topn as b
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.similarity import top_similar_jobs, wide_job_vectors

VECS = "job_hash long, field string, lang string, vec array<double>"
REFS = "user_id long, field string, lang string, vec array<double>"


def tables(spark, jobs=600, users=12, groups=20, seed=0, spread=0.15):
    """Postings around a few directions, as real fields of work lie."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 2, 6))
    rows = [(j, f, "FR" if j % 3 else "EN", (centres[j % groups, i] + spread * rng.normal(size=6)).tolist())
            for j in range(jobs) for i, f in enumerate(("description", "title"))]
    refs = [(u, f, lang, (centres[u % groups, i] + spread * rng.normal(size=6)).tolist())
            for u in range(users) for i, f in enumerate(("description", "title")) for lang in ("FR", "EN")]
    return rows, refs


def index(spark, vecs, tmp_dir, **kw):
    path = b.build_posting_index(vecs, f"{tmp_dir}/index", **kw)
    return b.read_posting_index(spark, path)


def every_pair(vecs, refs, n, seen=None):
    leaders = top_similar_jobs(wide_job_vectors(vecs), refs, n, seen=seen)
    return rows_of(top_n_per_group(leaders, "user_id", "score", n, "job_hash"))


def rows_of(df):
    return sorted((r["user_id"], r["rank"], r["job_hash"], None if r["score"] is None else round(r["score"], 9))
                  for r in df.collect())


def test_equals_scoring_every_pair_and_scores_far_fewer(spark, tmp_dir):
    rows, refs = tables(spark)
    vecs, refs = spark.createDataFrame(rows, VECS), spark.createDataFrame(refs, REFS)
    seen = spark.createDataFrame([(u, j) for u in range(12) for j in range(0, 600, 7)], "user_id long, job_hash long")
    postings, clusters = index(spark, vecs, tmp_dir)
    counts = {}
    got = rows_of(b.search_top_n(postings, clusters, refs, 5, seen=seen, counts=counts))
    assert got == every_pair(vecs, refs, 5, seen)
    assert len(got) == 60 and counts["pairs"] < 12 * 600 / 3


def test_radius_and_bound_hold_for_every_member(spark, tmp_dir):
    rows, refs = tables(spark, jobs=200, users=5, spread=0.8)
    vecs, refs = spark.createDataFrame(rows, VECS), spark.createDataFrame(refs, REFS)
    postings, clusters = index(spark, vecs, tmp_dir, clusters=9)
    bounds = {(r["user_id"], r["lang"], r["cluster"]): (r["bound"], np.array(r["vec"]))
              for r in b.cluster_bounds(refs, clusters).collect()}
    members = postings.collect()
    assert len(members) == 200 and sum(r["n"] for r in clusters.collect()) == 200
    for r in members:
        for u in range(5):
            bound, vec = bounds[u, r["lang"], r["cluster"]]
            assert float(np.array(r["vec"]) @ vec) <= bound + 1e-12


def test_missing_vectors_rank_last_and_ties_go_by_key(spark, tmp_dir):
    rows, refs = tables(spark, jobs=30, users=3, groups=3)
    same = rows[0][3], rows[1][3]
    rows += [(100 + i, f, "EN", list(same[k])) for i in range(9) for k, f in enumerate(("description", "title"))]
    rows += [(200, "title", "EN", [1.0] * 6), (201, "title", "FR", [0.0] * 6), (201, "description", "FR", [1.0] * 6),
             (202, "title", "FR", None), (202, "description", "FR", [1.0] * 6), (None, "title", "FR", [1.0] * 6)]
    refs = [r for r in refs if r[:3] != (2, "title", "FR")] + [(2, "title", "FR", [0.0] * 6)]
    vecs, refs = spark.createDataFrame(rows, VECS), spark.createDataFrame(refs, REFS)
    postings, clusters = index(spark, vecs, tmp_dir)
    for n in (4, 25, 60):
        assert rows_of(b.search_top_n(postings, clusters, refs, n)) == every_pair(vecs, refs, n)


def test_one_cluster_of_copies_is_cut_into_chunks(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(b, "CHUNK_ROWS", 50)
    rows, refs = tables(spark, jobs=40, users=6, groups=4)
    rows += [(1000 + i, f, "EN", list(rows[k][3])) for i in range(500) for k, f in enumerate(("description", "title"))]
    vecs, refs = spark.createDataFrame(rows, VECS), spark.createDataFrame(refs, REFS)
    postings, clusters = index(spark, vecs, tmp_dir)
    assert max(r["chunks"] for r in clusters.collect()) >= 10
    assert postings.groupBy("lang", "cluster", "chunk").count().agg(F.max("count")).first()[0] < 200
    counts = {}
    got = rows_of(b.search_top_n(postings, clusters, refs, 7, counts=counts, max_user_bytes=300))   # many user blocks
    assert got == every_pair(vecs, refs, 7)


def test_random_tables(spark, tmp_dir):
    for seed in (3, 4):
        rows, refs = tables(spark, jobs=150, users=7, groups=150, seed=seed, spread=1.0)   # no structure at all
        vecs, refs = spark.createDataFrame(rows, VECS), spark.createDataFrame(refs, REFS)
        postings, clusters = index(spark, vecs, f"{tmp_dir}/{seed}")
        assert rows_of(b.search_top_n(postings, clusters, refs, 3)) == every_pair(vecs, refs, 3)


def test_empty_tables(spark, tmp_dir):
    vecs, refs = spark.createDataFrame([], VECS), spark.createDataFrame([], REFS)
    postings, clusters = index(spark, vecs, tmp_dir)
    assert b.search_top_n(postings, clusters, refs, 3).count() == 0
    some = spark.createDataFrame(tables(spark, 10, 2)[0], VECS)
    postings, clusters = index(spark, some, f"{tmp_dir}/some")
    assert b.search_top_n(postings, clusters, refs, 3).count() == 0
