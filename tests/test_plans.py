"""Plan assertions: the physical plan is the one intended."""

from pyspark.sql import functions as F

from paths import SF_MID
from matchbook.operators.ranking import top_n_per_group
from matchbook.operators.seen import drop_seen, seen_hashes
from matchbook.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_seen_scan_is_pruned_and_filtered(spark):
    s = seen_hashes(fx.reviews(spark, SF_MID), "FastText")
    p = plan(s)
    assert "PushedFilters: [IsNotNull(toxic)]" in p
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in p


def test_anti_join_broadcasts_small_seen_set(spark):
    out = drop_seen(fx.postings(spark, SF_MID).select("job_hash"),
                    seen_hashes(fx.reviews(spark, SF_MID), "FastText"))
    out.collect()
    p = plan(out)
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_top_n_uses_partial_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("u"), F.col("id").alias("j"),
                                  (F.col("id") % 13).cast("double").alias("s"))
    p = top_n_per_group(df, "u", "s", 5, "j")._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p


def test_native_paths_have_no_python(spark):
    from matchbook.plans.catalog import QUERIES
    for name in ("job_hash", "tokenize", "dedup_first", "skill_share", "field_similarity",
                 "keyword_filter", "build_match_prompt", "upsert_partial_columns"):
        p = plan(QUERIES[name](spark, SF_MID))
        assert "Python" not in p and "ArrowEval" not in p, name


def test_automatic_broadcasts_are_decided_on_measured_sizes(spark):
    a = spark.range(5000).select((F.col("id") % 100).alias("k"), "id")
    b = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    j = a.join(b, "k")
    before = plan(j)
    assert "SortMergeJoin" in before and "BroadcastHashJoin" not in before   # no static guess
    assert len(j.collect()) == 5000
    after = plan(j)                       # the final adaptive plan, after the stages ran
    assert "isFinalPlan=true" in after and "BroadcastHashJoin" in after


def test_flagship_lookup_is_a_broadcast_of_the_ranked_lists(spark):
    from matchbook.plans.catalog import QUERIES
    p = plan(QUERIES["recommend"](spark, SF_MID))
    assert "ExistingRDD" in p                      # ranked lists read from their checkpoint
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # postings are not shuffled for the join (the local spread of the
    # single-row-group test file is a REPARTITION_BY_NUM exchange, not a join's)
    assert not [ln for ln in p.splitlines()
                if "hashpartitioning(job_hash" in ln and "ENSURE_REQUIREMENTS" in ln]


def test_runtime_conf_applies_the_broadcast_policy(spark):
    from matchbook.session import apply_runtime_conf
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.session.timeZone")
    saved = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        apply_runtime_conf(spark)                  # what the driver entry points call
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "64MB"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
