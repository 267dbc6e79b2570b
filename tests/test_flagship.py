"""The ranking flow per user, its reject outputs, and evaluate-once checks."""

import numpy as np
from pyspark.sql import functions as F

from matchbook.operators.merge import upsert
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.similarity import field_similarity, job_scores, top_similar_jobs, wide_job_vectors
from matchbook.plans.recommend import recommend, recommend_rejects
from matchbook.plans.scorers import default_registry, fasttext_scorer
from matchbook.plans.scoring_run import score_new_postings
from test_similarity import _data

STORE = "user_id int, job_hash string, llm_score int, fasttext_score double"


def _postings(spark, hashes):
    return spark.createDataFrame([(h, f"title {h}", "c") for h in hashes], "job_hash string, title string, company string")


def test_a_posting_is_seen_by_its_user_only(spark):
    jv, rv = _data(spark, n_jobs=40, n_users=3)
    posts = _postings(spark, [f"j{j:04d}" for j in range(45)])
    first = {r.user_id: r.job_hash for r in recommend(posts, jv, rv, spark.createDataFrame([], STORE), n=1).collect()}
    reviews = spark.createDataFrame([(0, first[0], None, 0.5), (1, first[0], 3, None), (2, "j0001", None, 0.1)], STORE)
    got = {}
    for r in recommend(posts, jv, rv, reviews, n=45).collect():
        got.setdefault(r.user_id, set()).add(r.job_hash)
    assert first[0] not in got[0] and first[0] in got[1] and first[0] in got[2] and "j0001" not in got[2]
    assert [len(got[u]) for u in range(3)] == [39, 40, 39]
    llm = {(r.user_id, r.job_hash) for r in recommend(posts, jv, rv, reviews, "LLM", n=45).collect()}
    assert (0, first[0]) in llm and (1, first[0]) not in llm


def test_what_cannot_be_ranked_is_listed(spark):
    jv, rv = _data(spark, n_jobs=10, n_users=3)
    posts = _postings(spark, [f"j{j:04d}" for j in range(12)])
    users = spark.createDataFrame([(0,), (1,), (7,)], "user_id int")
    refs = rv.where("not (user_id = 1 and lang = 'FR')")
    got = sorted(map(tuple, recommend_rejects(posts, jv, refs, users).collect()), key=repr)
    assert got == sorted([(None, "j0010", "no_vector"), (None, "j0011", "no_vector"),
                          (1, None, "not_ready"), (7, None, "not_ready")], key=repr)


def test_seen_pairs_leave_the_kernel_like_an_anti_join(spark):
    jv, rv = _data(spark)
    rng = np.random.default_rng(8)
    seen = spark.createDataFrame([(int(rng.integers(8)), f"j{rng.integers(320):04d}") for _ in range(900)] + [(None, "j0001"), (1, None)],
                                 "user_id int, job_hash string")
    n = 12
    scores = job_scores(field_similarity(jv, rv)).join(seen, ["user_id", "job_hash"], "left_anti")
    key = lambda r: (r.user_id, r.rank, r.job_hash, None if r.score is None else round(r.score, 9))
    want = sorted(map(key, top_n_per_group(scores, "user_id", "score", n, "job_hash").collect()))
    for how in ({}, {"max_ref_rows": 10}, {"job_salts": 1}, {"user_block": 2, "job_salts": 3}):
        leaders = top_similar_jobs(wide_job_vectors(jv), rv, n, seen=seen, **how)
        assert sorted(map(key, top_n_per_group(leaders, "user_id", "score", n, "job_hash").collect())) == want, how


def test_ranking_plan_collects_no_references(spark):
    jv, rv = _data(spark, n_jobs=20)
    plan = top_similar_jobs(wide_job_vectors(jv), rv, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" in plan


def _texts(spark):
    docs = [("a", "python spark data", "python data engineer", "en"), ("b", "java server", "java backend", "fr"),
            ("c", "haus bau", "bau", "de")]
    posts = spark.createDataFrame(docs, "job_hash string, description string, title string, lang string")
    pairs = posts.select(F.lit(1).alias("user_id"), "job_hash")
    return posts, pairs


def test_scorer_takes_the_mean_of_several_texts(spark):
    posts, pairs = _texts(spark)
    texts = spark.createDataFrame([(1, f, t) for f in ("description", "title")
                                   for t in ("python data", "spark cluster", "java")], "user_id int, field string, text string")
    got = {r.job_hash: r.score for r in fasttext_scorer(pairs, posts, texts).collect()}
    assert set(got) == {"a", "b"} and all(v is not None for v in got.values())


def test_scorer_keeps_languages_of_stored_vectors_apart(spark):
    posts, pairs = _texts(spark)
    en, fr = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    refs = spark.createDataFrame([(1, f, lang, v) for f in ("description", "title") for lang, v in (("EN", en), ("FR", fr))],
                                 "user_id int, field string, lang string, vec array<double>")
    one = {r.job_hash: r.score for r in fasttext_scorer(pairs, posts, refs=refs).collect()}
    same = refs.withColumn("vec", F.array(*[F.lit(1.0)] * 64))
    two = {r.job_hash: r.score for r in fasttext_scorer(pairs, posts, refs=same).collect()}
    assert one["a"] == two["a"] and one["b"] != two["b"]


RAW = [("Dev", "python spark", "2024-01-05T10:00:00Z", "u1"), ("Dev two", "python data", None, "u2"),
       ("Bau", "python bau", "2024-01-06T10:00:00Z", "u3"), ("Dev", "python again", None, "u4")]


def _raw(spark):
    df = spark.createDataFrame(RAW, "title string, description string, created string, redirect_url string")
    return df.select("title", "description", "created", "redirect_url",
                     F.struct(F.lit("acme").alias("display_name")).alias("company"),
                     F.struct(F.when(F.col("title") == "Bau", "DE").otherwise("EN").alias("display_name"),
                              F.array(F.lit("x")).alias("area")).alias("location"))


def test_nothing_vanishes_from_a_scoring_run(spark):
    keywords = spark.createDataFrame([(1, "python", "")], "user_id int, what_or string, what_exclude string")
    texts = spark.createDataFrame([(1, f, "python") for f in ("description", "title")], "user_id int, field string, text string")
    store = spark.createDataFrame([], STORE + ", llm_comment string, llm_version string, fasttext_version string")
    info, merged, rejects = score_new_postings(_raw(spark), keywords, store, "FastText", F.lower("location"), ref_texts=texts)
    assert merged.where("fasttext_score is not null").count() == 1
    got = sorted((r.url, r.reason) for r in rejects.collect())
    assert got == [("u2", "no_identity"), ("u3", "unsupported_language"), ("u4", "no_identity")]
    assert set(default_registry().names()) == {"FastText", "LLM"}


def test_hooks_are_called_once_a_row(spark):
    from matchbook.operators.generators import generate_keywords
    from matchbook.operators.textfilter import keyword_matches
    calls = spark.sparkContext.accumulator(0)

    def client(prompts):
        calls.add(len(prompts))
        return ['{"what_or": "python spark", "what_exclude": "java"}'] * len(prompts)
    profiles = spark.range(20).select(
        F.col("id").alias("user_id"), F.array(F.lit("dev")).alias("job_titles"), F.lit("x").alias("ideal_job"),
        F.array(F.struct(F.lit("s").alias("name"), F.lit(100).alias("weight_pct"))).alias("technical_skills"),
        F.lit(1).alias("education"), F.lit(1).alias("experience"), F.array(F.lit("s")).alias("sectors"))
    posts, _ = _texts(spark)
    got = keyword_matches(posts, generate_keywords(profiles, client), "job_hash", "description").collect()
    assert calls.value == 20 and len(got) == 20


def test_inference_calls_are_bounded_and_factories_run_in_tasks(spark):
    from matchbook.operators.embedding import HashingEmbedder, embed_texts, in_calls, made
    sizes = []
    assert in_calls(lambda xs: sizes.append(len(xs)) or xs, list(range(120)), 50) == list(range(120)) and sizes == [50, 50, 20]
    assert isinstance(made(lambda: HashingEmbedder(8)), HashingEmbedder) and made(HashingEmbedder(8)).dim == 8
    df = spark.createDataFrame([(i, f"word{i} more") for i in range(9)], "k int, t string")
    a = sorted(map(tuple, embed_texts(df, "k", "t", HashingEmbedder(8)).collect()))
    b = sorted(map(tuple, embed_texts(df, "k", "t", lambda: HashingEmbedder(8), batch_size=2).collect()))
    assert a == b


def test_planning_starts_no_job(spark):
    jv, rv = _data(spark, n_jobs=10)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    from matchbook.operators.embedding import embed_texts
    joined = jv.join(rv.select("user_id", "field").distinct(), "field").select("job_hash", F.col("lang").alias("t"))
    embed_texts(joined, "job_hash", "t")
    spark.sparkContext._jsc.clearJobGroup()
    assert not tracker.getJobIdsForGroup("plan-only")


def test_long_rows_take_the_shuffled_plans_with_the_same_result(spark):
    from matchbook.operators.seen import drop_seen
    from matchbook.operators.sizing import broadcast_if_small
    old = spark.createDataFrame([(i, "old", i) for i in range(30)], "k int, body string, n int")
    new = spark.createDataFrame([(i, "x" * 5000) for i in range(20, 40)], "k int, body string")
    assert broadcast_if_small(new)[1] and not broadcast_if_small(new, max_bytes=50_000)[1]
    big = upsert(old, new, "k", max_broadcast_bytes=50_000)
    assert "FullOuter" in big._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, big.collect())) == sorted(map(tuple, upsert(old, new, "k").collect()))
    keys = spark.createDataFrame([("k" * 3000 + str(i),) for i in range(50)], "k string")
    cand = keys.unionByName(spark.createDataFrame([("fresh",), (None,)], "k string"))
    small, large = (sorted(map(repr, drop_seen(cand, keys, ["k"], rows).collect())) for rows in (1000, 1))
    assert small == large and len(small) == 2


def test_upsert_refuses_null_keys(spark):
    import pytest
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="NULL keys"):
        upsert(old, spark.createDataFrame([(None, "b")], "k int, v string"), "k")
