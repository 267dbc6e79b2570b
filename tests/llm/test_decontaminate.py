import random
import re

import duckdb
from helpers import clashing, docs, fold, prose, sha

from matchbook.llm import decontaminate as d

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute(text, items, window=10):
    words = WORDS.findall(fold(text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        w = WORDS.findall(fold(item_text or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == w[i:i + n]:
                    hit |= set(range(at, at + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def cases(seed=0):
    r = random.Random(seed)
    items = [(i, prose(100 + i, r.randrange(1, 30), 6)) for i in range(25)]
    items += [(50, "Größe Ünit-test x"), (51, None), (52, ""), (53, "... !"), (None, "only here once"), (54, prose(104, 12, 6)), (4, prose(104, 12, 6))]
    rows = [(i, prose(i, r.randrange(1, 120), 6)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "GRÖSSE größe ünit-TEST x! größe ünit test X y"), (103, "ONLY here, once"), (None, items[3][1]),
             (1, items[5][1]), (1, items[5][1]), (104, "A" * 100_000), (105, prose(5, 20_000, 5000) + " " + prose(110, 25, 6))]
    return items, rows


def check(out, rows, items):
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["n_items"], r["contaminated"]) for r in out.collect()), key=repr)
    want = []
    for i, t in rows:
        n, h, f = brute(t, items)
        want.append((i, n, h, f, len(f), h > 0))
    assert got == sorted(want, key=repr)


def test_matches_brute_force_in_one_block_and_in_many(spark):
    items, rows = cases()
    table = clashing(docs(spark, rows), "n_words", "items", "len", "start")
    bench = clashing(spark.createDataFrame(items, ITEMS), "doc_id")
    check(d.find_benchmark(table, bench), rows, items)
    check(d.find_benchmark(table, bench, block_bytes=300), rows, items)


def test_tables_shift_and_find_like_a_plain_search():
    r = random.Random(5)
    for length in (1, 2, 3, 10):
        windows = {tuple(r.choices([b"a", b"b", b"c"], k=length)): {i} for i in range(12)}
        tables = d.WuManber(windows, length)
        words = r.choices([b"a", b"b", b"c", b"d"], k=400)
        want = [(i, windows[tuple(words[i:i + length])]) for i in range(400 - length + 1) if tuple(words[i:i + length]) in windows]
        assert list(tables.find(words)) == want


def test_empty_benchmark_and_documents(spark):
    rows = [(1, "a b c"), (2, None)]
    bench = spark.createDataFrame([], ITEMS)
    check(d.find_benchmark(docs(spark, rows), bench), rows, [])
    assert d.find_benchmark(docs(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


def test_query_and_oracle_on_the_fixture(spark, tmp_dir):
    items, rows = cases(2)
    docs(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_dir}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_dir}/{t}.parquet/*.parquet')")
    out = d.op4_decontaminate(spark, tmp_dir)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({d.OP4_SQL})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sha("") in {r["items_sha256"] for r in out.collect()}
