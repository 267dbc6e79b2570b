import __spark_entry__ as entry
from paths import SF_SMALL
from matchbook.plans.catalog import ORACLES, QUERIES


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["user_id", "rank", "job_hash", "score", "title", "company"]
    per_user = {}
    for r in rows:
        per_user.setdefault(r.user_id, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 10 for v in per_user.values())


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) >= 30
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(ORACLES) <= set(o) <= set(q)


def test_small_scale_queries_run(spark):
    queries = entry.queries()
    for name in QUERIES:
        fn = queries[name]
        if name.endswith("_stream") or name == "score_with_registry":
            continue
        assert fn(spark, SF_SMALL).count() >= 0, name
