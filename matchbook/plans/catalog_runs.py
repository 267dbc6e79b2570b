"""Queries around a run: pages as a data source, payloads as VARIANT, lists kept up
by deltas, paced model calls and completeness counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchbook.operators import clean
from matchbook.operators.seen import IMPLEMENTATIONS, SCORE_COLUMN
from matchbook.plans import fixtures as fx
from matchbook.plans.catalog import LANDED_SQL, PAGE_SIZE, RUN_DATE, TOP_LISTS_SQL, query
from matchbook.plans.catalog_stores import new_root
from matchbook.sources.tables import read_table

# --- pages ------------------------------------------------------------------

BROKEN_EVERY, BROKEN_AT = 7, 3


def _pages(spark, sf):
    """Rows of the data source over landed pages, one in seven of them cut short."""
    from matchbook.sources.landing import land_pages
    from matchbook.sources.page_source import PostingPages
    spark.dataSource.register(PostingPages)
    raw = fx.raw_postings(spark, sf).withColumn("page", (F.floor(F.col("pos") / PAGE_SIZE) + 1).cast("int"))
    whole = F.col("page") % BROKEN_EVERY != BROKEN_AT
    root = land_pages(raw.where(whole), "page", "pos", new_root(spark, "pages"))
    answer = F.to_json(F.struct(F.array(F.struct("title", "description")).alias("results")))
    (raw.where(~whole).groupBy("page").agg(F.min_by(answer, "pos").alias("answer"))
        .select("page", F.expr("substring(answer, 1, greatest(length(answer) div 2, 1))").alias("value"))
        .write.mode("append").partitionBy("page").text(root))
    return spark.read.format("posting_pages").option("path", root).load()


PAGE_SOURCE_SQL = f"SELECT * FROM ({LANDED_SQL}) WHERE page % {BROKEN_EVERY} <> {BROKEN_AT}"


@query("page_source", PAGE_SOURCE_SQL)
def q_page_source(spark, sf):
    from matchbook.sources.page_source import split_pages
    good, _ = split_pages(_pages(spark, sf))
    return clean.clean_postings(good, run_date=RUN_DATE).select(
        "page", "pos", "url", "title", "description", "posted_date", "company", "location")


PAGE_REJECTS_SQL = f"""
SELECT DISTINCT (doc_id // {PAGE_SIZE} + 1)::INTEGER AS page, 'JSONDecodeError' AS error
FROM documents WHERE (doc_id // {PAGE_SIZE} + 1) % {BROKEN_EVERY} = {BROKEN_AT}
"""


@query("page_source_rejects", PAGE_REJECTS_SQL)
def q_page_source_rejects(spark, sf):
    from matchbook.sources.page_source import split_pages
    _, broken = split_pages(_pages(spark, sf))
    return broken.select("page", F.substring_index("error", ":", 1).alias("error"))


# --- payloads -----------------------------------------------------------------

# The board's answers of two runs: the second one (documents in German) brings a
# field nobody declared, and the number of characters as a text.
PAYLOAD_SQL = """
WITH p AS (SELECT doc_id, lang, coalesce(lang = 'de', false) AS late FROM documents),
v AS (
  SELECT late, '$' AS path, 'OBJECT' AS type FROM p
  UNION ALL SELECT late, '$.id', 'NUMBER' FROM p
  UNION ALL SELECT late, '$.size', CASE WHEN late THEN 'STRING' ELSE 'NUMBER' END FROM p
  UNION ALL SELECT late, '$.company', 'OBJECT' FROM p WHERE NOT late OR doc_id % 2 = 0
  UNION ALL SELECT late, '$.company.display_name', 'STRING' FROM p WHERE NOT late OR doc_id % 2 = 0
  UNION ALL SELECT late, '$.area', 'ARRAY' FROM p
  UNION ALL SELECT late, '$.area[]', 'STRING' FROM p WHERE lang IS NOT NULL
  UNION ALL SELECT late, '$.salary', 'OBJECT' FROM p WHERE late
  UNION ALL SELECT late, '$.salary.min', 'NUMBER' FROM p WHERE late),
c AS (SELECT path, type, count(*) FILTER (NOT late) AS n_before, count(*) FILTER (late) AS n_after FROM v GROUP BY ALL),
k AS (SELECT path, sum(n_before) > 0 AS before, sum(n_after) > 0 AS after FROM c GROUP BY path)
SELECT path, type, n_before, n_after,
       CASE WHEN n_before = 0 THEN CASE WHEN k.before THEN 'new type' ELSE 'new path' END
            ELSE CASE WHEN k.after THEN 'gone type' ELSE 'gone path' END END AS change
FROM c JOIN k USING (path) WHERE n_before = 0 OR n_after = 0
"""


def _payloads(spark, sf):
    from matchbook.functions.payload import to_payload
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    late = F.coalesce(F.col("lang") == "de", F.lit(False))
    named = F.struct(F.col("source").alias("display_name"))
    record = F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.when(~late, F.col("n_chars")).alias("size"),
        F.when(~late | (F.col("doc_id") % 2 == 0), named).alias("company"),
        F.array_compact(F.array(F.upper("lang"))).alias("area"),
        F.when(late, F.struct((F.col("n_chars") * 2).alias("min"))).alias("salary")))
    # the later board writes the size as a text
    text = F.when(late, F.concat(F.lit('{"size":"'), F.col("n_chars").cast("string"), F.lit('",'), F.substr(record, F.lit(2))))
    return d.select("doc_id", "n_chars", late.alias("late"), to_payload(F.coalesce(text, record)).alias("payload"))


@query("payload_drift", PAYLOAD_SQL)
def q_payload_drift(spark, sf):
    from matchbook.functions.payload import drift_report, payload_paths
    from matchbook.session import cut_lineage
    paths = cut_lineage(payload_paths(_payloads(spark, sf), "payload", "late"))
    return drift_report(paths.where("not late").drop("late"), paths.where("late").drop("late"))


PAYLOAD_FIELDS_SQL = """
SELECT doc_id, doc_id AS id, CASE WHEN coalesce(lang = 'de', false) THEN NULL ELSE n_chars END AS size,
       CASE WHEN lang = 'de' THEN n_chars * 2 END AS salary_min,
       CASE WHEN coalesce(lang <> 'de', true) OR doc_id % 2 = 0 THEN source END AS company
FROM documents
"""


@query("payload_fields", PAYLOAD_FIELDS_SQL)
def q_payload_fields(spark, sf):
    # a size of another type reads as NULL (and is listed by payload_drift); the
    # field nobody declared is read from the same payload
    from matchbook.functions.payload import field
    p = _payloads(spark, sf)
    return p.select("doc_id", field("payload", "$.id", "bigint").alias("id"),
                    field("payload", "$.size", "bigint").alias("size"),
                    field("payload", "$.salary.min", "bigint").alias("salary_min"),
                    field("payload", "$.company.display_name", "string").alias("company"))


# --- top lists ------------------------------------------------------------------

LIST_GROUP = ["implementation", "user_id"]


@query("top_lists_by_deltas", TOP_LISTS_SQL)
def q_top_lists_by_deltas(spark, sf):
    # the lists of an older review store brought up to date by two deltas: first
    # removals and corrected scores, then reviews that are new
    from matchbook.operators.ranking import attach_info
    from matchbook.operators.top_list_store import apply_delta, build_reserve, shown
    from matchbook.session import cut_lineage
    wide = (fx.user_reviews(spark, sf).groupBy("user_id", "job_hash")
              .agg(F.max("llm_score").alias("llm_score"), F.max("fasttext_score").alias("fasttext_score")))
    final = None
    for name in IMPLEMENTATIONS:
        part = wide.select(F.lit(name).alias("implementation"), "user_id", "job_hash",
                           F.col(SCORE_COLUMN[name]).cast("double").alias("score")).where("score is not null")
        final = part if final is None else final.unionByName(part)
    final = cut_lineage(final)
    fresh, wrong, lost = (F.col("job_hash") % 5 == 0, F.col("job_hash") % 7 == 0, F.col("job_hash") % 3 == 0)
    extra = final.where(lost).select(*LIST_GROUP, (-F.col("job_hash") - 1).alias("job_hash"), F.lit(9.0).alias("score"))
    before = final.where(~fresh).withColumn("score", F.when(wrong, F.col("score") + 5).otherwise(F.col("score")))
    gone = extra.withColumn("score", F.lit(None).cast("double"))
    first = gone.unionByName(final.where(~fresh & wrong))
    reserve = cut_lineage(build_reserve(before.unionByName(extra), LIST_GROUP, depth=20))
    reserve = cut_lineage(apply_delta(reserve, first, final.where(~fresh), LIST_GROUP, 10, depth=20))
    reserve = apply_delta(reserve, final.where(fresh), final, LIST_GROUP, 10, depth=20)
    # a posting without info is still in its list, so the info is looked up afterwards
    info = fx.postings(spark, sf).select("job_hash", "title", "company")
    return attach_info(shown(reserve, 10), info, "job_hash").select(
        "implementation", "user_id", F.col("rank").cast("int").alias("rank"), "job_hash", "score", "title", "company")


# --- model calls and completeness ---------------------------------------------------

PACED_SQL = """
SELECT conv_id, turn, true AS reply_valid,
       ((('0x' || substr(md5(text), 1, 8))::UBIGINT) % 11)::INTEGER AS llm_score
FROM conversations WHERE role = 'user' AND text IS NOT NULL
"""


@query("paced_replies", PACED_SQL)
def q_paced_replies(spark, sf):
    # a prompt per user turn, all calls of the job on one schedule
    from matchbook.operators.paced_calls import paced_calls
    from matchbook.operators.scoring import OfflineReplyClient, parse_replies
    turns = read_table(spark, sf, "conversations").where("role = 'user' and text is not null")
    replies, _ = paced_calls(turns, "text", ["conv_id", "turn"], OfflineReplyClient(), rate=40, lanes=4)
    return parse_replies(replies).select("conv_id", "turn", "reply_valid", "llm_score")


ROUTED_SQL = """
SELECT doc_id, CASE lower(lang) WHEN 'fr' THEN 'FR' WHEN 'en' THEN 'EN' END AS model_lang,
       (SELECT count(*) FROM documents) AS rows_in,
       (SELECT count(*) FROM documents WHERE lower(lang) IN ('fr', 'en')) AS routed,
       (SELECT count(*) FROM documents WHERE NOT coalesce(lower(lang) IN ('fr', 'en'), false)) AS rejected
FROM documents
"""


@query("routing_completeness", ROUTED_SQL)
def q_routing_completeness(spark, sf):
    # the rows as they were written, with the counts of the pass that wrote them
    from matchbook.operators.textfilter import write_routed
    path = new_root(spark, "routed")
    counts = write_routed(read_table(spark, sf, "documents").select("doc_id", "lang"), path)
    return spark.read.parquet(path).select("doc_id", "model_lang", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
