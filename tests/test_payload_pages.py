import json
import os

from pyspark.sql import functions as F

from matchbook.functions.payload import drift_report, field, payload_paths, to_payload
from matchbook.sources.page_source import PARTITION_BYTES, Page, PostingPages, bundled, parse_page, split_pages
from matchbook.streaming.runner import run_to_table


def land(root, page, body):
    os.makedirs(f"{root}/page={page}", exist_ok=True)
    with open(f"{root}/page={page}/answer.json", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def posting(i, **more):
    return {"title": f"t{i}", "description": "d", "created": "2024-01-01T00:00:00Z", "redirect_url": f"u{i}",
            "company": {"display_name": "c"}, "location": {"display_name": "l", "area": ["a", "b"]}, **more}


def test_batch_reads_a_partition_per_page_and_lists_broken_ones(spark, tmp_dir):
    spark.dataSource.register(PostingPages)
    for p in range(1, 6):
        land(tmp_dir, p, {"results": [posting(p * 10 + i) for i in range(p)]})
    land(tmp_dir, 6, '{"results": [{"title"')
    land(tmp_dir, 7, {"other": 1})
    land(tmp_dir, 8, {"results": "none"})
    land(tmp_dir, 9, {"results": [None]})
    df = spark.read.format("posting_pages").option("path", tmp_dir).load()
    good, broken = split_pages(df)
    assert df.rdd.getNumPartitions() == 9
    rows = good.orderBy("page", "pos").collect()
    assert [(r.page, r.pos, r.title) for r in rows] == [(p, i, f"t{p * 10 + i}") for p in range(1, 6) for i in range(p)]
    assert rows[0].location.area == ["a", "b"] and rows[0].company.display_name == "c"
    assert {r.page: r.error.split(":")[0] for r in broken.collect()} == {
        6: "JSONDecodeError", 7: "KeyError", 8: "TypeError", 9: "AttributeError"}
    land(f"{tmp_dir}/none", 1, {"results": []})
    assert spark.read.format("posting_pages").option("path", f"{tmp_dir}/none").load().count() == 0


def test_stream_resumes_from_its_page(spark, tmp_dir):
    spark.dataSource.register(PostingPages)
    root, query = f"{tmp_dir}/pages", f"{tmp_dir}/query"

    def run():
        s = spark.readStream.format("posting_pages").option("path", root).load()
        return sorted((r.page, r.pos, r.title, r.error is None) for r in run_to_table(s, "t-pages", path=query).collect())
    for p in (1, 2, 3):
        land(root, p, {"results": [posting(p)]})
    first = run()
    assert first == [(p, 0, f"t{p}", True) for p in (1, 2, 3)]
    land(root, 1, {"results": [posting(99)]})                   # read already: not read again
    land(root, 4, "{")
    land(root, 5, {"results": [posting(5)]})
    assert [r for r in run() if r not in first] == [(4, None, None, False), (5, 0, "t5", True)]
    assert len(run()) == 5                                      # nothing new: nothing read twice


def test_parse_page_keeps_odd_values_as_text():
    rows = parse_page(3, json.dumps({"results": [{"title": 7, "company": None, "location": {"area": [1]}}, {}]}).encode())
    assert rows[0][:3] == (3, 0, "7") and rows[0][7] == (None, ["1"]) and rows[1][1] == 1 and rows[1][-1] is None


def payloads(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(to_payload("t").alias("p"))


def test_fields_survive_and_other_types_read_as_null(spark):
    df = payloads(spark, ['{"a": 1, "x": {"y": "z"}}', '{"a": "one"}', "no json", None])
    got = df.select(field("p", "$.a", "int").alias("a"), field("p", "$.x.y", "string").alias("y"),
                    field("p", "$.unknown", "string").alias("u")).collect()
    digits = payloads(spark, ['{"a": "7"}', '{"a": 7}']).select(field("p", "$.a", "int"), field("p", "$.a", "string"))
    assert [tuple(r) for r in digits.collect()] == [(None, "7"), (7, None)]
    assert [tuple(r) for r in got] == [(1, "z", None), (None, None, None), (None, None, None), (None, None, None)]


def test_paths_and_drift(spark):
    one = payloads(spark, ['{"a": 1, "b": [1, 2.5], "c": {"d": "x"}}', '{"a": 2, "c": null}'])
    two = payloads(spark, ['{"a": "1", "b": ["u"], "e": {"f": [{"g": true}]}}', '{"a": 3}'])
    before, after = payload_paths(one, "p"), payload_paths(two, "p")
    assert {tuple(r) for r in before.collect()} == {
        ("$", "OBJECT", 2), ("$.a", "NUMBER", 2), ("$.b", "ARRAY", 1), ("$.b[]", "NUMBER", 2), ("$.c", "OBJECT", 1),
        ("$.c", "VOID", 1), ("$.c.d", "STRING", 1)}
    assert {tuple(r) for r in drift_report(before, after).collect()} == {
        ("$.a", "STRING", 0, 1, "new type"), ("$.b[]", "STRING", 0, 1, "new type"), ("$.b[]", "NUMBER", 2, 0, "gone type"),
        ("$.c", "OBJECT", 1, 0, "gone path"), ("$.c.d", "STRING", 1, 0, "gone path"), ("$.e", "OBJECT", 0, 1, "new path"),
        ("$.e.f", "ARRAY", 0, 1, "new path"), ("$.e.f[]", "OBJECT", 0, 1, "new path"), ("$.e.f[].g", "BOOLEAN", 0, 1, "new path")}
    assert payload_paths(one.withColumn("k", F.lit(1)), "p", "k").columns == ["k", "path", "type", "n"]
    assert drift_report(before, before).count() == 0 and payload_paths(one.limit(0), "p").count() == 0


def test_many_pages_share_tasks_and_a_broken_one_spoils_no_other(spark, tmp_dir):
    spark.dataSource.register(PostingPages)
    for p in range(1, 201):
        land(tmp_dir, p, "{" if p % 50 == 0 else {"results": [posting(p * 10 + i) for i in range(2)]})
    df = spark.read.format("posting_pages").option("path", tmp_dir).load()
    assert 32 <= df.rdd.getNumPartitions() <= 100
    good, broken = split_pages(df)
    assert [(r.page, r.pos, r.title) for r in good.orderBy("page", "pos").collect()] == [
        (p, i, f"t{p * 10 + i}") for p in range(1, 201) if p % 50 for i in range(2)]
    assert sorted(r.page for r in broken.collect()) == [50, 100, 150, 200]
    big = [Page(n, [("f", PARTITION_BYTES * (n % 10 == 0))]) for n in range(1, 301)]
    assert [p.number for b in bundled(big) for p in b.pages] == list(range(1, 301))
    assert all(len(b.pages) == 1 or sum(p.weight for p in b.pages) <= PARTITION_BYTES for b in bundled(big))
