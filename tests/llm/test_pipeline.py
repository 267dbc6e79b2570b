import zlib

import corpus_pipeline as p
from helpers import LABELS, clashing, docs, prose, shingles
from test_decontaminate import ITEMS, brute
from test_toxicity import INSULTS


def fixture(spark, folder):
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            words[9], words[30] = INSULTS[i % 4], INSULTS[(i + 1) % 4]
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[7 * i + 1][1] + " copy", "hot") for i in range(30)]
    rows += [(2000 + i, f"{prose(3000 + i, 40)} {prose(777, 12)} end", "hot") for i in range(9)]
    rows += [(3000 + i, f'{prose(4000 + i, 30)} token = "{zlib.crc32(str(i).encode()):08x}9b0b3c6a43eb" é', "hot") for i in range(9)]
    rows += [(4000, None, "s0"), (4001, "", None), (None, prose(5000, 20), None), (2, rows[2][1], "s2")]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(777, 12)), (2, None)], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_dir):
    rows = fixture(spark, tmp_dir)
    table = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    out = {}
    for name, stage in p.STAGES:
        made = stage(spark, table, tmp_dir)
        made.write.parquet(f"{tmp_dir}/{name}")
        table = spark.read.parquet(f"{tmp_dir}/{name}")
        out[name] = table.collect()
        if name != "mixing":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [r["text"] for r in out["toxicity"]]
    assert not any(w in (t or "").split() for t in clean for w in INSULTS)
    assert len(clean) == len([r for r in rows if not any(w in (r[1] or "").split() for w in INSULTS)])
    kept = out["ngram_jaccard_join"]
    sets = [shingles(r["text"]) if r["doc_id"] is not None else set() for r in kept]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) if a for b in sets[:i])
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in out["toxicity"]} - set(range(1000, 1030))
    items = [(1, prose(777, 12)), (2, None)]
    assert {r["doc_id"] for r in out["benchmark_decontamination"]} == {
        r["doc_id"] for r in kept if not brute(r["text"], items)[1]} == {r["doc_id"] for r in kept} - set(range(2000, 2009))
    before = {r["doc_id"]: r for r in out["benchmark_decontamination"]}
    after = {r["doc_id"]: r for r in out["secret_scans"]}
    for ident, r in after.items():
        if ident is not None and 3000 <= ident < 3009:
            assert r["text"].endswith('[SECRET]" é') and r["n_chars"] == len(r["text"])
        else:
            assert r == before[ident]
    mixed = out["mixing"]
    assert len(mixed) == len(after) and all(r["taken"] <= 2 * r["size"] for r in mixed)
    assert sorted(map(tuple, p.run(spark, tmp_dir).collect()), key=repr) == sorted(map(tuple, mixed), key=repr)


def test_rows_that_share_an_id_go_only_when_linked(spark):
    rows = [(1, prose(1, 40)), (1, prose(2, 40)), (1, prose(1, 40)), (2, prose(2, 40)), (3, prose(3, 40)), (None, "x"), (None, "x"),
            (5, None), (5, "clean text"), (6, None), (6, None), (7, prose(7, 40)), (7, prose(7, 40) + " end")]
    got = [(r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, docs(spark, rows), "").collect()]
    want = [(1, prose(1, 40)), (2, prose(2, 40)), (3, prose(3, 40)), (None, "x"), (None, "x"), (5, "clean text"), (6, None)]
    seven = [t for i, t in got if i == 7]
    assert len(seven) == 1 and seven[0] in (rows[-1][1], rows[-2][1])
    assert sorted([g for g in got if g[0] != 7], key=repr) == sorted(want, key=repr)


def test_clashing_columns_and_long_texts_pass_every_stage(spark, tmp_dir):
    rows = fixture(spark, tmp_dir)[:60]
    long = prose(9, 150_000)
    secret = "sk_live_0123456789abcdef0QzT7pLm9XvB2kRw8YdF4"
    table = docs(spark, rows + [(7000, long), (7001, long + " more"), (7002, f"{prose(11, 120_000)} {secret}")])
    names = ["_score", "n_words", "n_hit", "n_items", "items", "contaminated", "_hits", "_items", "_key", "_id", "_any",
             "component_id", "n_shingles", "_spans", "_base", "_tokens", "_wider", "_found", "size", "taken", "target", "label"]
    table = clashing(table, *names)
    for name, stage in p.STAGES:
        made = stage(spark, table, tmp_dir)
        if name == "mixing":
            assert made.count() == table.count()
            continue
        assert made.columns == table.columns
        made.write.parquet(f"{tmp_dir}/clash-{name}")
        table = spark.read.parquet(f"{tmp_dir}/clash-{name}")
        assert table.filter(" or ".join(f"coalesce(`{n}`, '') <> 'extra'" for n in names)).count() == 0
        kept = {r["doc_id"]: r["text"] for r in table.filter("doc_id >= 7000").collect()}
        assert set(kept) == ({7000, 7001, 7002} if name == "toxicity" else {7000, 7002}) and kept[7000] == long
    assert kept[7002].endswith(" [SECRET]") and "QzT7" not in kept[7002]
    bare = docs(spark, [(1, f"x {secret}")]).select("doc_id", "text")            # no n_chars to renew
    assert p.redact_secrets(spark, bare, tmp_dir).first()["text"] == "x [SECRET]"


def test_empty_documents(spark, tmp_dir):
    docs(spark, []).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert p.run(spark, tmp_dir).count() == 0
