"""Unit tests for the small operators: ratings (P16), language routing
(P18, A7, U2), the distinct seen set (A6), icons and dimensions (F11, S11),
prompt templates (F12) and the raw payload (P6)."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from matchbook.functions import dims
from matchbook.functions.prompts import Template
from matchbook.operators.clean import flatten_postings
from matchbook.operators.ratings import rating_rows
from matchbook.operators.seen import seen_hashes
from matchbook.operators.textfilter import language_report


def test_rating_rows_drop_unrated_and_keep_latest(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t, 1, True, 5), (1, "a", t + dt.timedelta(hours=1), 2, True, 8),
            (1, "b", t, 3, False, 9),                                   # shown, not rated
            (2, "a", t, 4, True, 3), (2, "a", t, 5, True, 4)]           # same time: id breaks the tie
    df = spark.createDataFrame(rows, "user_id long, job_hash string, ts timestamp, event_id long, "
                                     "wants_to_rate boolean, score int")
    got = {(r.user_id, r.job_hash): r.score for r in rating_rows(df).collect()}
    assert got == {(1, "a"): 8, (2, "a"): 4}


def test_language_report_adds_up(spark):
    langs = ["fr"] * 5 + ["en"] * 3 + ["de"] * 2 + ["EN", None]
    df = spark.createDataFrame([(x,) for x in langs], "lang string")
    rep = {r.lang: (r.model_lang, r.n_rows, r.routed) for r in language_report(df).collect()}
    assert rep["fr"] == ("FR", 5, True)
    assert rep["en"] == ("EN", 3, True) and rep["EN"] == ("EN", 1, True)
    assert rep["de"] == (None, 2, False) and rep[None] == (None, 1, False)
    assert sum(v[1] for v in rep.values()) == len(langs)          # routed + rejected = input


def test_seen_hashes_distinct_per_implementation(spark):
    rows = [(1, "a", 7, None), (1, "a", 7, None), (1, "b", None, 0.4), (2, "a", None, 0.1)]
    rev = spark.createDataFrame(rows, "user_id long, job_hash string, llm_score int, "
                                      "fasttext_score double")
    llm = sorted(map(tuple, seen_hashes(rev, "LLM").collect()))
    fast = sorted(map(tuple, seen_hashes(rev, "FastText").collect()))
    assert llm == [(1, "a")]                                       # duplicates collapse
    assert fast == [(1, "b"), (2, "a")]
    with pytest.raises(ValueError):
        seen_hashes(rev, "Other")


def test_sector_dim_and_icons(spark):
    d = dims.sector_dim(spark)
    assert d.count() == len(dims.SECTORS)
    row = d.select(dims.with_icon(F.col("icon"), F.col("category")).alias("x"), "icon",
                   "category").first()
    assert row.x == f"{row.icon} {row.category}"
    # a missing icon leaves the bare label (concat_ws skips NULL)
    x = spark.range(1).select(dims.with_icon(F.lit(None).cast("string"), F.lit("Lbl")).alias("x"))
    assert x.first().x == "Lbl"


def test_template_column_and_sql_render_the_same(spark):
    t = Template("Hello {name}, you are {age} ({note}).\n")
    assert t.slots == ["name", "age", "note"]
    df = spark.createDataFrame([("Zoé", 41, "it's fine")], "name string, age int, note string")
    got = df.select(t.column(name="name", age=F.col("age").cast("string"), note="note")
                    .alias("p")).first().p
    sql = t.sql(name="'Zoé'", age="41::VARCHAR", note="'it''s fine'")
    want = duckdb.sql(f"SELECT {sql}").fetchall()[0][0]
    assert got == want == "Hello Zoé, you are 41 (it's fine).\n"
    with pytest.raises(ValueError):
        t.column(name="name")                                      # slots without a column


def test_raw_payload_keeps_the_record(spark):
    raw = spark.createDataFrame(
        [("T", "D", "2024-02-03T10:00:00+02:00", "https://x.invalid/1", ("Acme",), ("Paris", ["FR", "IDF"]))],
        "title string, description string, created string, redirect_url string, "
        "company struct<display_name:string>, location struct<display_name:string, area:array<string>>")
    flat = flatten_postings(raw).first()
    payload = json.loads(flat.raw_payload)
    assert payload["company"] == {"display_name": "Acme"}
    assert payload["location"]["area"] == ["FR", "IDF"]
    assert payload["created"] == "2024-02-03T10:00:00+02:00"
    assert (flat.company, flat.location, flat.url) == ("Acme", "Paris", "https://x.invalid/1")


def test_size_probes_boundaries(spark):
    from matchbook.operators.sizing import ELEMENT_BYTES, ROW_OVERHEAD_BYTES, fits_in_bytes, has_at_most
    df = spark.range(0, 1000, 1, 7)
    assert has_at_most(df, 1000) and not has_at_most(df, 999)
    v = spark.range(10).select(F.array_repeat(F.lit(1.0), 4).alias("v"))
    exact = 10 * ROW_OVERHEAD_BYTES + 40 * ELEMENT_BYTES
    assert fits_in_bytes(v, "v", max_bytes=exact, max_rows=10)
    assert not fits_in_bytes(v, "v", max_bytes=exact - 1, max_rows=10)
    assert not fits_in_bytes(v, "v", max_bytes=exact, max_rows=9)
