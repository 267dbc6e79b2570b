import pytest
from pyspark.sql import functions as F

from matchbook.operators.merge import upsert
from matchbook.operators.seen import drop_seen
from matchbook.operators.seen_filter import build_filters, drop_seen_by_store, perhaps_seen
from matchbook.operators.textfilter import keyword_matches
from matchbook.sources import keyed_store as ks
from matchbook.sources import manifest
from matchbook.sources.term_index import append_batch, bucket_of, indexed_keyword_matches, read_postings_of

STORE = "job_hash long, llm_score int, fasttext_score double, tags array<string>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def store(spark, tmp_dir, n=400, parts=16, **kw):
    df = spark.range(n).select(F.col("id").alias("job_hash"), (F.col("id") % 11).cast("int").alias("llm_score"),
                               F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("fasttext_score"),
                               F.array(F.col("id").cast("string")).alias("tags"))
    ks.create_store(df, f"{tmp_dir}/s", "job_hash", parts, **kw)
    return f"{tmp_dir}/s", df


def test_merge_equals_the_whole_merge_and_rewrites_touched_parts_only(spark, tmp_dir):
    root, df = store(spark, tmp_dir)
    delta = spark.createDataFrame([(5, 1.5), (9, None), (1000, 2.5)], "job_hash int, fasttext_score double")
    before = manifest.read(spark, root)[1]
    assert ks.merge_store(spark, root, delta) == 2
    want = upsert(df, delta.withColumn("job_hash", F.col("job_hash").cast("long")), "job_hash")
    assert rows(ks.read_store(spark, root)) == rows(want.select(*df.columns))
    after = manifest.read(spark, root)[1]
    changed = {p for p in after if after[p] != before.get(p)}
    ids = spark.createDataFrame([(5,), (9,), (1000,)], "k long")
    touched = {str(r["p"]) for r in ids.select(ks.part_of(["k"], 16).alias("p")).collect()}
    assert changed == touched and len(changed) <= 3 < len(after)
    assert rows(ks.read_store(spark, root, version=1)) == rows(df)             # the old version stays readable
    read = ks.read_store(spark, root, only_parts={int(p) for p in touched})
    assert {r["p"] for r in read.select(ks.part_of(["job_hash"], 16).alias("p")).distinct().collect()} == {int(p) for p in touched}


def test_interrupted_merge_leaves_the_old_snapshot(spark, tmp_dir, monkeypatch):
    root, df = store(spark, tmp_dir)
    delta = spark.createDataFrame([(5, 99)], "job_hash long, llm_score int")

    def dies(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", dies)
        with pytest.raises(RuntimeError):
            ks.merge_store(spark, root, delta)
    assert rows(ks.read_store(spark, root)) == rows(df)
    assert ks.merge_store(spark, root, delta) == 2
    assert ks.read_store(spark, root).where("job_hash = 5").first()["llm_score"] == 99


def test_two_writers_of_one_version(spark, tmp_dir):
    root, _ = store(spark, tmp_dir, 10)
    version, entries, info = manifest.read(spark, root)
    manifest.commit(spark, root, version + 1, entries, info)
    with pytest.raises(Exception, match="(?i)exists"):
        manifest.commit(spark, root, version + 1, entries, info)


def test_new_columns_empty_deltas_and_bad_keys(spark, tmp_dir):
    root, df = store(spark, tmp_dir, 50)
    assert ks.merge_store(spark, root, df.limit(0)) == 1
    ks.merge_store(spark, root, spark.createDataFrame([(3, "x"), (70, "y")], "job_hash long, note string"))
    got = {r["job_hash"]: r for r in ks.read_store(spark, root).collect()}
    assert len(got) == 51 and got[3]["note"] == "x" and got[3]["llm_score"] == 3 and got[4]["note"] is None
    assert got[70]["llm_score"] is None and got[70]["tags"] is None
    for bad in ([(1, 2), (1, 3)], [(None, 2)]):
        with pytest.raises(ValueError):
            ks.merge_store(spark, root, spark.createDataFrame(bad, "job_hash long, llm_score int"))
    with pytest.raises(ValueError):
        ks.read_store(spark, f"{tmp_dir}/nothing")
    ks.create_store(df.limit(0), f"{tmp_dir}/empty", "job_hash", 4)
    assert ks.read_store(spark, f"{tmp_dir}/empty").count() == 0
    ks.merge_store(spark, f"{tmp_dir}/empty", df.limit(3))
    assert ks.read_store(spark, f"{tmp_dir}/empty").count() == 3


FILTERS = {"FastText": "fasttext_score", "LLM": "llm_score"}


def test_filters_never_miss_a_key_and_rarely_err(spark):
    held = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 1).alias("v"),
                                      F.pmod("id", F.lit(5)).cast("int").alias("part"))
    filters = build_filters(held, ["k"], {"n": "v"})
    part = F.pmod("k", F.lit(5)).cast("int")
    asked = spark.range(40_000).withColumnRenamed("id", "k")
    got = perhaps_seen(asked, filters, "n", ["k"], part).groupBy(
        ((F.col("k") < 20_000) & (F.col("k") % 2 == 0)).alias("held"), "perhaps").count().collect()
    n = {(r["held"], r["perhaps"]): r["count"] for r in got}
    assert n[True, True] == 10_000 and (True, False) not in n
    assert n.get((False, True), 0) < 0.05 * 30_000


def test_unseen_by_filter_equals_the_anti_join_after_upserts(spark, tmp_dir):
    root, df = store(spark, tmp_dir, 900, filters=FILTERS)
    delta = spark.createDataFrame([(1, 0.5), (3, None), (5000, 0.1)], "job_hash long, fasttext_score double")
    ks.merge_store(spark, root, delta)
    asked = spark.range(6000).select(F.col("id").alias("job_hash"), (F.col("id") * 2).alias("extra"))
    for name, col in FILTERS.items():
        seen = ks.read_store(spark, root).where(F.col(col).isNotNull()).select("job_hash")
        assert rows(drop_seen_by_store(asked, root, name)) == rows(drop_seen(asked, seen))
    left = {r["job_hash"] for r in drop_seen_by_store(asked, root, "FastText").collect()}
    assert 1 not in left and 3 in left and 5000 not in left
    twice = asked.unionByName(asked.limit(100))                                 # repeated candidates stay repeated
    assert drop_seen_by_store(twice, root, "FastText").count() > len(left)


def test_most_candidates_bypass_the_shuffle(spark, tmp_dir):
    root, _ = store(spark, tmp_dir, 2000, filters=FILTERS)
    asked = spark.range(1000, 50_000).withColumnRenamed("id", "job_hash")
    flagged = perhaps_seen(asked, ks.read_filters(spark, root), "FastText", ["job_hash"], ks.part_of(["job_hash"], 16))
    assert flagged.where("perhaps").count() < 4000
    plan = drop_seen_by_store(asked, root, "FastText")._jdf.queryExecution().executedPlan().toString()
    absent = plan.split("Union")[1].split("left_anti")[0] if "left_anti" in plan else plan.split("Union")[1]
    assert "BroadcastHashJoin" in absent
    assert drop_seen_by_store(asked.limit(0), root, "LLM").count() == 0


DOCS = "doc_id long, text string"


def test_index_equals_the_texts_after_appended_batches(spark, tmp_dir):
    docs = spark.createDataFrame([(i, f"Spark engineer number{i % 7} {'Paris' if i % 2 else 'Lyon'} x{i}") for i in range(60)] +
                                 [(60, None), (61, "")], DOCS)
    kw = spark.createDataFrame([(1, "number3 paris", "x5 x17"), (2, "spark", "lyon"), (3, "nothing", None), (4, None, "spark"),
                                (5, "x1 x2 x3", "")], "user_id long, what_or string, what_exclude string")
    root = f"{tmp_dir}/idx"
    append_batch(docs.where("doc_id < 20"), root, "a", buckets=32)
    append_batch(docs.where("doc_id between 20 and 45"), root, "b")
    assert rows(indexed_keyword_matches(spark, root, kw)) == rows(keyword_matches(docs.where("doc_id <= 45"), kw))
    append_batch(docs.where("doc_id > 45"), root, "c")
    assert rows(indexed_keyword_matches(spark, root, kw)) == rows(keyword_matches(docs, kw))
    assert rows(indexed_keyword_matches(spark, root, kw, version=1)) == rows(keyword_matches(docs.where("doc_id < 20"), kw))
    append_batch(docs.where("doc_id < 10"), root, "a")                          # a corrected batch replaces its own
    assert rows(indexed_keyword_matches(spark, root, kw)) == rows(keyword_matches(docs.where("doc_id < 10 or doc_id >= 20"), kw))


def test_only_asked_buckets_are_read(spark, tmp_dir):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 13 + j}" for j in range(13))) for i in range(40)], DOCS)
    root = f"{tmp_dir}/idx"
    append_batch(docs, root, "a", buckets=64)
    asked = spark.createDataFrame([("w7",), ("w300",)], "term string")
    found = read_postings_of(spark, root, asked)
    buckets = {r["b"] for r in asked.select(bucket_of("term", 64).alias("b")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and all(str(b) in filters for b in buckets)
    files = [f for f in found.inputFiles() if any(f"bucket={b}/" in f for b in buckets)]
    assert rows(found) == [(0, "w7"), (23, "w300")] and files
