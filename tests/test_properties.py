"""Properties from the test strategy: partition-count invariance of whole
queries, and set identities of the seen-set anti-join."""

import math

from pyspark.sql import functions as F

from paths import SF_SMALL
from matchbook.operators.seen import drop_seen, seen_hashes
from matchbook.plans import fixtures as fx
from matchbook.plans.catalog import QUERIES


def _canon(df):
    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


def test_queries_do_not_depend_on_shuffle_partitions(spark):
    names = ["recommend", "dedup_first", "keyword_filter", "cooldown_accept", "skill_share",
             "upsert_partial_columns", "page_slice", "top_n_per_user", "rating_projection",
             "job_scores", "global_top_n", "score_with_registry", "build_reference_embeddings"]
    results = {}
    for p in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        results[p] = {n: _canon(QUERIES[n](spark, SF_SMALL)) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for n in names:
        assert results["1"][n] == results["64"][n], n


def test_anti_join_is_disjoint_and_complete(spark):
    posts = fx.postings(spark, SF_SMALL).select("job_hash")
    seen = seen_hashes(fx.reviews(spark, SF_SMALL), "FastText")
    for limit in (5_000_000, 0):          # broadcast and shuffled plans
        unseen = drop_seen(posts, seen, max_broadcast_rows=limit)
        u = {r.job_hash for r in unseen.collect()}
        s = {r.job_hash for r in seen.collect()}
        p = {r.job_hash for r in posts.collect()}
        assert not (u & s)
        assert u | (p & s) == p
