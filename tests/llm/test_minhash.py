import hashlib

import numpy as np
from helpers import clashing, docs, prose, shingles

from matchbook.llm import minhash as m
from matchbook.llm.shingles import SEGMENT, fold_words, shingle_hashes, shingle_set, word_hashes, words_in_common


def compared(spark, rows, parts=4):
    table = clashing(docs(spark, rows), "fingerprint", "id", "part", "ghost", "hash").repartition(parts)
    return m.with_next(table, "doc_id", "text", m._compare,
                       "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                       "edited_fingerprint string, near_edited double, near_next double").collect()


def test_neighbours_edits_and_likeness(spark):
    rows = [(3 * i, prose(i, 5 + i % 90)) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "é🙂ñ" * 40), (1003, "one two"), (None, "no id here " * 9), (-5, prose(7, 9000))]
    rows += [(2000, rows[40][1]), (1999, rows[40][1])]
    got = {r["doc_id"]: r for r in compared(spark, rows)}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    errors = []
    for i, (ident, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + other[:k]
        r = got[ident]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == m.fingerprint(text.encode()) and r["edited_fingerprint"] == m.fingerprint(edited.encode())
        for near, b in (("near_edited", edited), ("near_next", other)):
            x, y = shingles(text), shingles(b)
            errors.append(r[near] - (len(x & y) / len(x | y) if x | y else 1.0))
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25
    assert got[2000]["near_next"] == 1.0 and got[2000]["fingerprint"] == got[1999]["fingerprint"]


def test_partitions_do_not_matter_and_small_tables(spark):
    rows = [(i, prose(i, 12)) for i in range(40)]
    assert sorted(compared(spark, rows, 1)) == sorted(compared(spark, rows, 9))
    assert compared(spark, []) == []
    one = compared(spark, [(7, "a b c d e f g")])[0]
    assert one["near_next"] == 1.0
    twice = compared(spark, [(7, "same row"), (7, "same row"), (7, "other")])
    assert len(twice) == 3 and sum(r["near_next"] for r in twice) == 1.0


def test_one_id_and_rows_without_id_are_cut(spark):
    from pyspark.sql import functions as F
    rows = [(i, prose(i, 8)) for i in range(60)] + [(30, prose(100 + i, 8)) for i in range(150)]
    rows += [(None, prose(500 + i, 8)) for i in range(90)] + [(2**60 + i, prose(700 + i, 8)) for i in range(20)]
    table = docs(spark, rows)
    placed = table.select(F.col("doc_id").alias("id"), "text")
    placed = placed.select("id", "text", F.xxhash64("text").alias("h"), m._part(placed, 16).alias("part")).collect()
    order = sorted(placed, key=lambda r: (r["id"] is not None, r["id"] or 0, r["h"]), reverse=True)
    assert [r["part"] for r in order] == sorted((r["part"] for r in order), reverse=True)
    most = {}
    for r in order:
        most[r["part"]] = most.get(r["part"], 0) + 1
    assert max(most.values()) <= 60 and len(most) >= 12
    got = {(r["doc_id"], r["fingerprint"], r["edited_sha256"]) for r in compared(spark, rows)}
    for i, r in enumerate(order):
        text, other = r["text"], order[(i + 1) % len(order)]["text"]
        k = len(text) // 3
        edited = (text[:len(text) - k] + other[:k]).encode()
        assert (r["id"], m.fingerprint(text.encode()), hashlib.sha256(edited).hexdigest()) in got


def test_near_pairs_are_verified_and_recalled(spark):
    rows = []
    for g in range(30):
        words = prose(g, 120).split()
        for c in range(4):
            w = list(words)
            w[10 + 20 * c] = f"changed{c}"
            rows.append((10 * g + c, " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, rows[0][1])]
    texts = dict(rows)
    got = m.near_pairs(docs(spark, rows)).collect()
    for r in got:
        x, y = shingles(texts[r["id"]]), shingles(texts[r["rep"]])
        assert (r["both"], r["either"]) == (len(x & y), len(x | y)) and 100 * r["both"] >= 75 * r["either"]
    parent = {i: i for i in texts}
    for r in got:
        parent[r["id"]] = min(parent[r["id"]], r["rep"])
    assert sum(parent[i] != i for i in texts) >= 0.9 * 91
    assert m.near_pairs(docs(spark, [])).count() == 0


def test_near_pairs_within_a_large_family(spark, monkeypatch):
    """Planted pairs at about 0.77 among texts that are all alike at about 0.6:
    the smallest id of a bucket is linked with none of them."""
    base = prose(1, 200).split()

    def changed(words, places, mark):
        out = list(words)
        for k in places:
            out[k] = f"{mark}x{k}"
        return out
    rows, n, planted = [], 1200, 25
    for i in range(n):
        rows.append((i, " ".join(changed(base, [(i * 7 + 41 * k) % 200 for k in range(5)], f"m{i}"))))
    for i in range(planted):
        words = changed(base, [(i * 11 + 37 * k) % 200 for k in range(5)], f"p{i}")
        other = changed(words, [(i * 11 + 18 + 37 * k) % 200 for k in range(5)], f"q{i}")
        rows += [(n + 2 * i, " ".join(words)), (n + 2 * i + 1, " ".join(other))]
    rows += [(9000, rows[-1][1]), (9001, rows[-1][1])]
    texts = dict(rows)
    monkeypatch.setattr(m, "TILE_ROWS", 40)
    got = {(r["id"], r["rep"]): (r["both"], r["either"]) for r in m.near_pairs(docs(spark, rows)).collect()}
    assert all((n + 2 * i + 1, n + 2 * i) in got for i in range(planted))
    assert {(9000, n + 2 * planted - 1), (9001, n + 2 * planted - 1)} <= got.keys()
    for (a, b), counts in got.items():
        x, y = shingles(texts[a]), shingles(texts[b])
        assert counts == (len(x & y), len(x | y)) and 100 * counts[0] >= 75 * counts[1] and b < a


def test_near_classes_are_the_components_of_the_pairs(spark, monkeypatch):
    rows = []
    for g in range(6):
        words = prose(g, 110).split()
        for c in range(5 + 9 * g):
            w = list(words)
            w[(7 * c) % 100] = f"changed{c}"
            rows.append((100 * g + c, " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, rows[0][1]), (9003, rows[0][1]), (9004, prose(77, 4)), (None, rows[0][1])]
    monkeypatch.setattr(m, "TILE_ROWS", 8)
    got = m.near_classes(clashing(docs(spark, rows), "id", "copy", "rep", "links")).collect()
    assert len(got) == len(rows)
    pairs = [(r["id"], r["rep"]) for r in m.near_pairs(docs(spark, rows)).collect()]
    texts, parent = dict(rows), {i: i for i, _ in rows}
    for _ in range(8):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    links = {i: len({texts[b if a == i else a] for a, b in pairs if i in (a, b)} - {texts[i]}) for i in texts}
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == parent[i] if i is not None else r["component_id"] is None
        assert r["n_links"] == (0 if i is None else links[0] if i in (9002, 9003) else links[i])
    assert m.near_classes(docs(spark, [])).count() == 0


def test_word_hashes_across_segments():
    text = " ".join(f"Word{i}x" for i in range(SEGMENT // 5)).encode() + b" " + b"y" * (SEGMENT + 10) + b"\t\x0bend\xc2\xa0of  text"
    words, got = fold_words(text), word_hashes(text)
    assert len(words) == len(got) and len(set(words)) == len(np.unique(got))
    small = [word_hashes(w)[0] for w in words[:50] + words[-2:]]
    assert small == list(got[:50]) + list(got[-2:])
    assert len(word_hashes(b"")) == len(word_hashes(b" \n\x0c")) == 0


def test_shingle_hashes_count_like_word_tuples():
    for seed in range(20):
        text = prose(seed, seed * 3, 5)
        assert len(shingle_set(text.encode())) == len(shingles(text))
    a, b = prose(1, 60, 9), prose(1, 50, 9) + " tail"
    x, y = shingles(a), shingles(b)
    assert words_in_common(a.encode(), b.encode()) == (len(x & y), len(x | y))
    assert shingle_hashes(word_hashes(b"a b"))[0] != shingle_hashes(word_hashes(b"b a"))[0]
