"""Queries over stored tables: the posting index, the inverted index, keyed
stores with touched-partition merges, and the seen set's filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchbook.operators.bounded_topn import build_posting_index, read_posting_index, search_top_n
from matchbook.operators.embedding import elementwise_mean, ready_references
from matchbook.operators.ranking import attach_info
from matchbook.operators.seen import seen_hashes
from matchbook.operators.seen_filter import drop_seen_by_store
from matchbook.plans import fixtures as fx
from matchbook.plans.catalog import JV_SQL, KEYWORD_SQL, RECOMMEND_SQL, UNSEEN_SQL, UPSERT_SQL, keyword_table, query
from matchbook.session import ensure_checkpoint_dir
from matchbook.sources.keyed_store import create_store, merge_store, read_store
from matchbook.sources.tables import read_table
from matchbook.sources.term_index import append_batch, indexed_keyword_matches


def new_root(spark, name: str) -> str:
    """A folder below the shared one for a store this run builds."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stores/{name}-{uuid.uuid4().hex}"


@query("recommend_by_bounds", RECOMMEND_SQL)
def q_recommend_by_bounds(spark, sf):
    # the flagship's rows from the clustered index instead of every pair
    posts = fx.postings(spark, sf)
    vecs = fx.job_field_vectors(spark, sf).join(posts.select("job_hash"), "job_hash", "left_semi")
    postings, clusters = read_posting_index(spark, build_posting_index(vecs, new_root(spark, "posting-index")))
    refs = ready_references(fx.user_reference_vectors(spark, sf))
    seen = seen_hashes(fx.user_reviews(spark, sf), "FastText", distinct=False)
    best = search_top_n(postings, clusters, refs, 10, seen=seen)
    return attach_info(best, posts.select("job_hash", "title", "company"), "job_hash").select(
        "user_id", F.col("rank").cast("int").alias("rank"), "job_hash", F.round("score", 6).alias("score"), "title", "company")


@query("keyword_filter_indexed", KEYWORD_SQL)
def q_keyword_filter_indexed(spark, sf):
    # three landed batches, appended one after another
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    root = new_root(spark, "term-index")
    for name, rows in (("fr", docs.where("lang = 'fr'")), ("de", docs.where("lang = 'de'")),
                       ("rest", docs.where("coalesce(lang not in ('fr', 'de'), true)"))):
        append_batch(rows, root, name, buckets=64)
    return indexed_keyword_matches(spark, root, keyword_table(spark, sf))


@query("review_store_merge", UPSERT_SQL)
def q_review_store_merge(spark, sf):
    # a run's scores merged into the stored reviews, touched partitions only
    old = fx.reviews(spark, sf).select(
        "job_hash", "llm_score", "fasttext_score",
        F.concat(F.lit("quality "), F.col("llm_score").cast("string")).alias("llm_comment"),
        F.lit("1.0.0").alias("llm_version"), F.lit("1.0.0").alias("fasttext_version"))
    root = new_root(spark, "reviews")
    create_store(old, root, "job_hash", parts=32)
    fresh = read_table(spark, sf, "documents").where("lang = 'fr'").select(
        F.col("doc_id").alias("job_hash"), (F.col("n_chars") / 40000.0).alias("fasttext_score"),
        F.lit("1.1.0").alias("fasttext_version"))
    merge_store(spark, root, fresh)
    return read_store(spark, root)


REFERENCE_MERGE_SQL = f"""
WITH {JV_SQL},
fresh_long AS (
  SELECT label + 5 AS user_id, field, lang, i, avg(x) AS m, count(*) AS n
  FROM (SELECT label, field, lang, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM jv WHERE job_hash % 3 = 0)
  GROUP BY ALL),
fresh AS (SELECT DISTINCT user_id, field, lang FROM fresh_long)
SELECT user_id, field, lang, i::INTEGER AS dim, round(m, 6) AS value, n AS n_vectors, 'saved' AS origin
FROM refs_long WHERE (user_id, field, lang) NOT IN (SELECT (user_id, field, lang) FROM fresh)
UNION ALL
SELECT f.user_id, f.field, f.lang, f.i::INTEGER, round(f.m, 6), f.n, CASE WHEN r.user_id IS NOT NULL THEN 'saved' END
FROM fresh_long f LEFT JOIN (SELECT DISTINCT user_id, field, lang FROM refs_long) r USING (user_id, field, lang)
"""


@query("reference_vector_merge", REFERENCE_MERGE_SQL)
def q_reference_vector_merge(spark, sf):
    # Vectors of a new generator run replace a user's saved ones by
    # (user, field, lang); columns the run does not bring stay
    keys = ["user_id", "field", "lang"]
    root = new_root(spark, "references")
    create_store(fx.user_reference_vectors(spark, sf).withColumn("origin", F.lit("saved")), root, keys, parts=16)
    run = fx.job_field_vectors(spark, sf).where("job_hash % 3 = 0").withColumn("user_id", F.col("label") + 5)
    merge_store(spark, root, elementwise_mean(run, keys, "vec", dim=fx.EMBED_DIM))
    saved = read_store(spark, root).select(*keys, "n_vectors", "origin", F.posexplode("vec").alias("i", "value"))
    return saved.select(*keys, (F.col("i") + 1).alias("dim"), F.round("value", 6).alias("value"), "n_vectors", "origin")


def _initcap(e: str) -> str:
    return f"(upper(substr({e}, 1, 1)) || lower(substr({e}, 2)))"


PROFILE_MERGE_SQL = f"""
WITH old AS (SELECT c_custkey AS user_id, [c_name, {_initcap('c_mktsegment')} || ' specialist'] AS job_titles,
                    'Hands-on ' || lower(c_mktsegment) || ' work' AS ideal_job,
                    [{_initcap('c_mktsegment')} || ':60', 'Spark:40'] AS skills,
                    (c_nationkey % 4)::INTEGER AS education, (c_nationkey % 5)::INTEGER AS experience, [c_mktsegment] AS sectors
             FROM customer),
form AS (SELECT c_custkey + CASE WHEN c_acctbal < 500 THEN 1000000 ELSE 0 END AS user_id,
                [c_name, 'Lead ' || lower(c_mktsegment)] AS job_titles, [c_mktsegment || ':100'] AS skills,
                ((c_nationkey + 1) % 5)::INTEGER AS experience
         FROM customer WHERE c_acctbal < 5000)
SELECT coalesce(o.user_id, f.user_id) AS user_id,
       array_to_string(CASE WHEN f.user_id IS NOT NULL THEN f.job_titles ELSE o.job_titles END, '|') AS job_titles,
       o.ideal_job, array_to_string(CASE WHEN f.user_id IS NOT NULL THEN f.skills ELSE o.skills END, '|') AS skills,
       o.education, CASE WHEN f.user_id IS NOT NULL THEN f.experience ELSE o.experience END AS experience,
       array_to_string(o.sectors, '|') AS sectors
FROM old o FULL OUTER JOIN form f ON o.user_id = f.user_id
"""


@query("profile_merge", PROFILE_MERGE_SQL)
def q_profile_merge(spark, sf):
    # Saved forms (array columns) merged into the stored profiles
    root = new_root(spark, "profiles")
    create_store(fx.profiles(spark, sf), root, "user_id", parts=32)
    c = read_table(spark, sf, "customer").where("c_acctbal < 5000")
    form = c.select(
        (F.col("c_custkey") + F.when(F.col("c_acctbal") < 500, 1_000_000).otherwise(0)).alias("user_id"),
        F.array("c_name", F.concat(F.lit("Lead "), F.lower("c_mktsegment"))).alias("job_titles"),
        F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit(100).alias("weight_pct"))).alias("technical_skills"),
        ((F.col("c_nationkey") + 1) % 5).alias("experience"))
    merge_store(spark, root, form)
    skills = F.transform("technical_skills", lambda s: F.concat_ws(":", s["name"], s["weight_pct"].cast("string")))
    return read_store(spark, root).select(
        "user_id", F.array_join("job_titles", "|").alias("job_titles"), "ideal_job", F.array_join(skills, "|").alias("skills"),
        "education", "experience", F.array_join("sectors", "|").alias("sectors"))


@query("unseen_by_filter", UNSEEN_SQL)
def q_unseen_by_filter(spark, sf):
    # two runs' reviews; the second upsert renews the filters of its partitions
    reviews = fx.reviews(spark, sf)
    root = new_root(spark, "seen")
    create_store(reviews.where("job_hash % 2 = 0"), root, "job_hash", parts=16,
                 filters={"FastText": "fasttext_score", "LLM": "llm_score"})
    merge_store(spark, root, reviews.where("job_hash % 2 <> 0"))
    return drop_seen_by_store(fx.postings(spark, sf).select("job_hash", "lang", "company"), root, "FastText")
