"""Driver query catalog: one builder per query name, plus DuckDB oracles.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame that
exercises the library operator for that query.  Oracles are independent
SQL formulations over the raw tables (DuckDB dialect).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from matchbook.plans import fixtures as fx
from matchbook.plans.recommend import recommend, recommend_rejects

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# Shared oracle fragments --------------------------------------------------
JV_SQL = """
jv AS (
  SELECT vec_id // 2 AS job_hash,
         CASE WHEN vec_id % 2 = 0 THEN 'description' ELSE 'title' END AS field,
         CASE WHEN (vec_id // 2) % 2 = 0 THEN 'FR' ELSE 'EN' END AS lang,
         label, embedding::DOUBLE[] AS vec
  FROM embeddings),
refs_long AS (
  SELECT label AS user_id, field, lang, i, avg(x) AS m, count(*) AS n
  FROM (SELECT label, field, lang, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM jv)
  GROUP BY ALL),
refs AS (
  SELECT user_id, field, lang, list(m ORDER BY i) AS vec, max(n) AS n_vectors
  FROM refs_long GROUP BY ALL)"""


# the fixture's review store: who was scored on what, by implementation
USER_SEEN_SQL = """
user_reviews AS (SELECT ((doc_id // 3) % 8)::INTEGER AS user_id, doc_id // 2 AS job_hash, quality AS llm_score,
                        CASE WHEN doc_id % 5 <> 0 THEN toxic::DOUBLE END AS fasttext_score FROM labels),
seen AS (SELECT DISTINCT user_id, job_hash FROM user_reviews WHERE fasttext_score IS NOT NULL)"""


# --- flagship ---------------------------------------------------------------

RECOMMEND_SQL = f"""
WITH {JV_SQL},
{USER_SEEN_SQL},
ready AS (SELECT user_id FROM refs WHERE vec IS NOT NULL GROUP BY user_id
          HAVING count(DISTINCT field || lang) = 4),
sims AS (
  SELECT r.user_id, j.job_hash, list_cosine_similarity(j.vec, r.vec) AS sim
  FROM jv j JOIN refs r USING (field, lang)
  WHERE j.job_hash IN (SELECT doc_id FROM documents) AND r.user_id IN (SELECT user_id FROM ready)
    AND (r.user_id, j.job_hash) NOT IN (SELECT (user_id, job_hash) FROM seen)),
scores AS (
  SELECT user_id, job_hash, CASE WHEN count(sim) = 2 THEN avg(sim) END AS score
  FROM sims GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, job_hash) AS rk
  FROM scores)
SELECT r.user_id, r.rk::INTEGER AS rank, r.job_hash, round(r.score, 6) AS score,
       split_part(d.text, chr(10), 1) AS title, d.source AS company
FROM ranked r JOIN documents d ON d.doc_id = r.job_hash
WHERE r.rk <= 10
"""


@query("recommend", RECOMMEND_SQL)
def q_recommend(spark: SparkSession, sf: str) -> DataFrame:
    return recommend(fx.postings(spark, sf), fx.job_field_vectors(spark, sf),
                     fx.user_reference_vectors(spark, sf), fx.user_reviews(spark, sf),
                     implementation="FastText", n=10)


REJECTS_SQL = f"""
WITH {JV_SQL},
ready AS (SELECT user_id FROM refs WHERE vec IS NOT NULL GROUP BY user_id HAVING count(DISTINCT field || lang) = 4)
SELECT NULL::INTEGER AS user_id, doc_id AS job_hash, 'no_vector' AS reason FROM documents
WHERE doc_id NOT IN (SELECT job_hash FROM jv)
UNION ALL
SELECT DISTINCT user_id, NULL::BIGINT, 'not_ready' FROM events
WHERE user_id NOT IN (SELECT user_id FROM ready)
"""


@query("recommend_rejects", REJECTS_SQL)
def q_recommend_rejects(spark, sf):
    # everyone who asks for a ranking, and every posting, is ranked or listed
    users = read_table(spark, sf, "events").select(F.col("user_id").cast("int").alias("user_id"))
    return recommend_rejects(fx.postings(spark, sf), fx.job_field_vectors(spark, sf),
                             fx.user_reference_vectors(spark, sf), users)


# Imports used by the remaining builders.
from pyspark.sql import functions as F  # noqa: E402

from matchbook.functions import dims, text as T  # noqa: E402
from matchbook.functions.prompts import IDEAL_JOB_PROMPT, KEYWORD_PROMPT, MATCH_PROMPT  # noqa: E402
from matchbook.operators import clean, identity, ordering, textfilter  # noqa: E402
from matchbook.operators.cooldown import cooldown_accept  # noqa: E402
from matchbook.operators.embedding import elementwise_mean, with_readiness  # noqa: E402
from matchbook.operators.merge import upsert  # noqa: E402
from matchbook.operators.profile import skill_share, standard_rules, validate_profiles, weight_out_of_bounds  # noqa: E402
from matchbook.operators.ranking import attach_info, top_n, top_n_per_group  # noqa: E402
from matchbook.operators.scoring import parse_replies  # noqa: E402
from matchbook.operators.seen import IMPLEMENTATIONS, drop_seen, seen_hashes  # noqa: E402
from matchbook.operators.similarity import (field_similarity, job_scores, top_similar_jobs,  # noqa: E402
                                            wide_job_vectors)
from matchbook.session import cut_lineage  # noqa: E402
from matchbook.sources.tables import read_table  # noqa: E402

WS = T.PY_WHITESPACE_RE2


def _strip_sql(e):
    return T.strip_sql_duckdb(e)


# --- ingest and identity ----------------------------------------------------

RUN_DATE = "2024-03-01"

RAW_POSTINGS_CTE = """raw AS (
  SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, text AS description,
         strftime(DATE '2024-01-01' + (doc_id % 60)::INTEGER, '%Y-%m-%d') || 'T' ||
           lpad((doc_id % 24)::VARCHAR, 2, '0') || ':30:00' ||
           CASE WHEN lang = 'fr' THEN '+02:00' WHEN lang = 'de' THEN '-05:00' ELSE 'Z' END AS created,
         'https://jobs.invalid/' || doc_id::VARCHAR AS redirect_url,
         nullif(source, 'src0') AS company_name, upper(lang) AS loc_name,
         [upper(lang), source] AS area
  FROM documents)"""

FLATTEN_SQL = f"""
WITH {RAW_POSTINGS_CTE}
SELECT pos, redirect_url AS url, lower(description) AS description, lower(title) AS title,
       TRY_CAST(substr(created, 1, 10) AS DATE) AS posted_date,
       upper(coalesce(company_name, 'unknown')) AS company,
       to_json(area) AS area_json, loc_name AS location, DATE '{RUN_DATE}' AS retrieved_date,
       to_json(struct_pack(title := title, description := description, created := created,
                           redirect_url := redirect_url,
                           company := struct_pack(display_name := company_name),
                           location := struct_pack(display_name := loc_name, area := area))) AS raw_payload
FROM raw
"""


@query("flatten_clean_postings", FLATTEN_SQL)
def q_flatten_clean_postings(spark, sf):
    return clean.clean_postings(fx.raw_postings(spark, sf), run_date=RUN_DATE)


RAW_JSON_SQL = """
SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k,
       to_json(struct_pack(event_id := event_id, event_type := event_type,
                           k := json_extract_string(props, '$.k')::INTEGER)) AS payload,
       to_json([event_type, user_id::VARCHAR]) AS tags_json
FROM events
"""


@query("raw_json_roundtrip", RAW_JSON_SQL)
def q_raw_json_roundtrip(spark, sf):
    from matchbook.functions.jsonx import json_path
    e = read_table(spark, sf, "events").withColumn("k", json_path("props", "$.k", "int"))
    return e.select("event_id", "k",
                    F.to_json(F.struct("event_id", "event_type", "k"),
                              {"ignoreNullFields": "false"}).alias("payload"),
                    F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("tags_json"))


def _hash_sql(title, company, date):
    return (f"sha256(lower({_strip_sql(title)}) || '_' || lower({_strip_sql(company)}) || '_' || "
            f"year({date})::VARCHAR || '_' || month({date})::VARCHAR)")


JOB_HASH_SQL = f"""
SELECT doc_id AS job_id,
       {_hash_sql("split_part(text, chr(10), 1)", "source", "(DATE '2024-01-01' + (doc_id % 60)::INTEGER)")} AS job_hash
FROM documents
"""


@query("job_hash", JOB_HASH_SQL)
def q_job_hash(spark, sf):
    p = fx.postings(spark, sf)
    return p.select(F.col("job_hash").alias("job_id"),
                    identity.job_hash("title", "company", "posted_date").alias("job_hash"))


DEDUP_SQL = f"""
SELECT job_hash, o_orderkey, o_custkey, o_totalprice, o_orderdate FROM (
  SELECT *, {_hash_sql("o_custkey::VARCHAR", "''", "o_orderdate")} AS job_hash FROM orders)
QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY o_orderkey) = 1
"""


@query("dedup_first", DEDUP_SQL)
def q_dedup_first(spark, sf):
    o = read_table(spark, sf, "orders")
    h = identity.job_hash(F.col("o_custkey").cast("string"), F.lit(""), F.col("o_orderdate"))
    keyed = o.select(h.alias("job_hash"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return identity.dedup_first(keyed, "job_hash", ["o_orderkey"])


LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DEDUP_LINES_SQL = f"""
SELECT job_hash, {", ".join(LINE_COLS)} FROM (
  SELECT *, {_hash_sql("l_partkey::VARCHAR", "l_suppkey::VARCHAR", "l_shipdate")} AS job_hash FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY {", ".join(LINE_COLS)}) = 1
"""


@query("dedup_first_lines", DEDUP_LINES_SQL)
def q_dedup_first_lines(spark, sf):
    # (l_orderkey, l_linenumber) repeats in this table, so the source order is
    # extended with every column until it is total.
    li = read_table(spark, sf, "lineitem")
    h = identity.job_hash(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                          F.col("l_shipdate"))
    keyed = li.select(h.alias("job_hash"), *LINE_COLS)
    return identity.dedup_first(keyed, "job_hash", LINE_COLS)


PAGE_SQL = """
SELECT doc_id, rn AS row_index, (rn - 1) // 50 + 1 AS page, ((rn - 1) % 50 + 1)::BIGINT AS pos_in_page
FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents)
"""


@query("page_slice", PAGE_SQL)
def q_page_slice(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return ordering.page_slice(d, ["source", "doc_id"], per_page=50).select(
        "doc_id", "row_index", "page", "pos_in_page")


# --- text -------------------------------------------------------------------

# Search terms per user (query parameters, as a keyword generator returns them),
# for every profile: of the document with its number, counted round, the title's
# words of at least ten letters, or the longest word of its text where the title
# has none; nothing in the other big language.
SEARCH_LETTERS = 10
KW_SQL = f"""kw AS (
  SELECT user_id, array_to_string(CASE WHEN len(long) > 0 THEN long ELSE longest END, ' ') AS what_or,
         CASE WHEN lang = 'en' THEN 'le' ELSE 'the' END AS what_exclude
  FROM (SELECT c_custkey AS user_id, lang,
               list_filter({T.tokenize_sql_duckdb("split_part(text, chr(10), 1)")}, lambda x: length(x) >= {SEARCH_LETTERS}) AS long,
               list_transform(list_sort(list_transform({T.tokenize_sql_duckdb("text")},
                                                       lambda x: {{'n': -length(x), 'x': x}}))[1:1], lambda p: p.x) AS longest
        FROM customer JOIN documents ON doc_id = c_custkey % (SELECT count(*) FROM documents)))"""

KEYWORD_SQL = f"""
WITH {KW_SQL},
kt AS (SELECT user_id, unnest(string_split(what_or, ' ')) AS term, false AS bad FROM kw
       UNION SELECT user_id, what_exclude, true FROM kw),
t AS (SELECT doc_id, unnest(list_distinct({T.tokenize_sql_duckdb("text")})) AS term FROM documents)
SELECT kt.user_id, t.doc_id FROM t JOIN kt ON kt.term = t.term AND kt.term <> ''
GROUP BY kt.user_id, t.doc_id HAVING bool_or(NOT bad) AND NOT bool_or(bad)
"""


def keyword_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    long = F.filter(T.tokenize(fx.title(F.col("text"))), lambda x: F.length(x) >= SEARCH_LETTERS)
    longest = F.array_min(F.transform(T.tokenize("text"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    terms = docs.select(
        F.col("doc_id").alias("number"), long.alias("long"), longest["x"].alias("longest"),
        F.when(F.col("lang") == "en", "le").otherwise("the").alias("what_exclude"))
    # tokenised once a document, before the profiles (more than one may share it) join
    terms = terms.select("number", F.when(F.size("long") > 0, F.array_join("long", " ")).otherwise(F.col("longest"))
                         .alias("what_or"), "what_exclude")
    users = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % docs.count()).alias("number"))
    # a run reads the terms for the search, the prompts and the reference texts
    return cut_lineage(users.join(terms, "number").drop("number"))


@query("keyword_filter", KEYWORD_SQL)
def q_keyword_filter(spark, sf):
    d = read_table(spark, sf, "documents")
    return textfilter.keyword_matches(d, keyword_table(spark, sf), "doc_id", "text")


TOKENIZE_SQL = f"""
SELECT doc_id, len(toks)::INTEGER AS n_tokens, array_to_string(toks, ' ') AS tokens_text
FROM (SELECT doc_id, {T.tokenize_sql_duckdb("text")} AS toks FROM documents)
"""


@query("tokenize", TOKENIZE_SQL)
def q_tokenize(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens_text"))


LANG_SQL = """
SELECT lang, model_lang, count(*) AS n_rows, model_lang IS NOT NULL AS routed
FROM (SELECT lang, CASE lower(lang) WHEN 'fr' THEN 'FR' WHEN 'en' THEN 'EN' END AS model_lang FROM documents)
GROUP BY ALL
"""


@query("language_routing", LANG_SQL)
def q_language_routing(spark, sf):
    return textfilter.language_report(read_table(spark, sf, "documents").select("lang"))


# --- seen set and anti-join ---------------------------------------------------

SEEN_SQL = """
SELECT DISTINCT 'FastText' AS implementation, doc_id AS job_hash FROM labels WHERE toxic IS NOT NULL
UNION ALL
SELECT DISTINCT 'LLM' AS implementation, doc_id AS job_hash FROM labels WHERE quality IS NOT NULL
"""


@query("seen_hashes", SEEN_SQL)
def q_seen_hashes(spark, sf):
    r = fx.reviews(spark, sf)
    parts = [seen_hashes(r, impl).select(F.lit(impl).alias("implementation"), "job_hash")
             for impl in IMPLEMENTATIONS]
    return parts[0].unionByName(parts[1])


UNSEEN_SQL = """
SELECT doc_id AS job_hash, lang, source AS company FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)
"""


@query("unseen_postings", UNSEEN_SQL)
def q_unseen_postings(spark, sf):
    p = fx.postings(spark, sf).select("job_hash", "lang", "company")
    return drop_seen(p, seen_hashes(fx.reviews(spark, sf), "FastText", distinct=False))


# --- vectors ------------------------------------------------------------------

CENTROID_SQL = f"""
WITH {JV_SQL},
ready AS (SELECT user_id, count(DISTINCT field || lang) = 4 AS ready FROM refs GROUP BY user_id)
SELECT r.user_id, r.field, r.lang, r.i::INTEGER AS dim, round(r.m, 6) AS value, r.n AS n_vectors, ready.ready
FROM refs_long r JOIN ready USING (user_id)
"""


@query("reference_centroids", CENTROID_SQL)
def q_reference_centroids(spark, sf):
    refs = fx.user_reference_vectors(spark, sf)
    long = with_readiness(refs).select("user_id", "field", "lang", "n_vectors", "ready",
                                       F.posexplode("vec").alias("i", "value"))
    return long.select(
        "user_id", "field", "lang", (F.col("i") + 1).alias("dim"),
        F.round("value", 6).alias("value"), "n_vectors", "ready")


TOKEN_POOL_SQL = """
SELECT item, i::INTEGER AS dim, round(avg(x), 6) AS value, count(*) AS n_tokens FROM (
  SELECT vec_id // 5 AS item, unnest(range(1, len(embedding) + 1)) AS i,
         unnest(embedding::DOUBLE[]) AS x FROM embeddings)
GROUP BY ALL
"""


@query("token_mean_pool", TOKEN_POOL_SQL)
def q_token_mean_pool(spark, sf):
    pooled = elementwise_mean(fx.token_vectors(spark, sf), "item", "vec", dim=fx.EMBED_DIM)
    return pooled.select("item", F.col("n_vectors").alias("n_tokens"),
                         F.posexplode("vec").alias("i", "value")).select(
        "item", (F.col("i") + 1).alias("dim"), F.round("value", 6).alias("value"), "n_tokens")


FIELD_SIM_SQL = f"""
WITH {JV_SQL}
SELECT r.user_id, j.job_hash, j.field, j.lang, round(list_cosine_similarity(j.vec, r.vec), 6) AS similarity
FROM jv j JOIN refs r USING (field, lang)
"""


def _field_sims(spark, sf):
    return field_similarity(fx.job_field_vectors(spark, sf), fx.user_reference_vectors(spark, sf))


@query("field_similarity", FIELD_SIM_SQL)
def q_field_similarity(spark, sf):
    return _field_sims(spark, sf).withColumn("similarity", F.round("similarity", 6))


SCORES_CTE = f"""
WITH {JV_SQL},
scores AS (
  SELECT r.user_id, j.job_hash,
         CASE WHEN count(list_cosine_similarity(j.vec, r.vec)) = 2
              THEN avg(list_cosine_similarity(j.vec, r.vec)) END AS score
  FROM jv j JOIN refs r USING (field, lang) GROUP BY ALL)"""

JOB_SCORES_SQL = SCORES_CTE + "\nSELECT user_id, job_hash, round(score, 6) AS score FROM scores"


@query("job_scores", JOB_SCORES_SQL)
def q_job_scores(spark, sf):
    return job_scores(_field_sims(spark, sf)).withColumn("score", F.round("score", 6))


TOP_N_SQL = SCORES_CTE + """
SELECT s.user_id, s.rk::INTEGER AS rank, s.job_hash, round(s.score, 6) AS score,
       split_part(d.text, chr(10), 1) AS title, d.source AS company
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, job_hash) AS rk
      FROM scores) s
JOIN documents d ON d.doc_id = s.job_hash
WHERE s.rk <= 10
"""


@query("top_n_per_user", TOP_N_SQL)
def q_top_n_per_user(spark, sf):
    # Ranking goes through the block kernel: only per-batch leaders leave
    # the tasks, never users x jobs similarity rows.
    jv = fx.job_field_vectors(spark, sf).select("job_hash", "field", "lang", "vec")
    leaders = top_similar_jobs(wide_job_vectors(jv), fx.user_reference_vectors(spark, sf), 10)
    top = top_n_per_group(leaders, "user_id", "score", 10, "job_hash")
    info = fx.postings(spark, sf).select("job_hash", "title", "company")
    return attach_info(top, info, "job_hash").select(
        "user_id", "rank", "job_hash", F.round("score", 6).alias("score"), "title", "company")


GLOBAL_TOP_SQL = """
SELECT implementation, rk::INTEGER AS rank, event_id, user_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY implementation ORDER BY value DESC NULLS LAST, event_id) AS rk
  FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END AS implementation
        FROM events))
WHERE rk <= 10
"""


@query("global_top_n", GLOBAL_TOP_SQL)
def q_global_top_n(spark, sf):
    e = read_table(spark, sf, "events")
    impl = F.when(F.col("event_type").isin("click", "view"), "FastText").otherwise("LLM")
    e = e.select("event_id", "user_id", "value", impl.alias("implementation"))
    parts = []
    for name in IMPLEMENTATIONS:
        best = top_n(e.where(F.col("implementation") == name), "value", 10, "event_id")
        # rank within the n kept rows (n rows, so the window is trivial)
        parts.append(top_n_per_group(best, "implementation", "value", 10, "event_id"))
    out = parts[0].unionByName(parts[1])
    return out.select("implementation", "rank", "event_id", "user_id", "value")


# --- text-scorer side -------------------------------------------------------------

def _initcap_sql(e):
    return f"(upper(substr({e}, 1, 1)) || lower(substr({e}, 2)))"


EDU_SQL = dims.map_sql_duckdb(dims.EDUCATION_LABELS, "(c_nationkey % 4)")
EXP_SQL = dims.map_sql_duckdb(dims.EXPERIENCE_LABELS, "(c_nationkey % 5)")
_TITLES_SQL = f"c_name || ', ' || {_initcap_sql('c_mktsegment')} || ' specialist'"
_SKILLS_SQL = f"{_initcap_sql('c_mktsegment')} || ', Spark'"

MATCH_PROMPT_SQL = f"""
WITH {KW_SQL},
kt AS (SELECT user_id, unnest(string_split(what_or, ' ')) AS term, false AS bad FROM kw
       UNION SELECT user_id, what_exclude, true FROM kw),
t AS (SELECT doc_id, unnest(list_distinct({T.tokenize_sql_duckdb("text")})) AS term FROM documents),
pairs AS (SELECT kt.user_id, t.doc_id FROM t JOIN kt ON kt.term = t.term AND kt.term <> ''
          GROUP BY kt.user_id, t.doc_id HAVING bool_or(NOT bad) AND NOT bool_or(bad))
SELECT c.c_custkey AS user_id, d.doc_id AS job_hash,
       {MATCH_PROMPT.sql(titles=_TITLES_SQL,
                         ideal_job="'Hands-on ' || lower(c_mktsegment) || ' work'",
                         skills=_SKILLS_SQL,
                         education=f"coalesce({EDU_SQL}, 'unknown')",
                         experience=f"coalesce({EXP_SQL}, 'unknown')",
                         job_title="coalesce(split_part(d.text, chr(10), 1), '')",
                         company="coalesce(d.source, '')",
                         description="substr(coalesce(d.text, ''), 1, 1000)")} AS prompt
FROM pairs p JOIN documents d ON d.doc_id = p.doc_id JOIN customer c ON c.c_custkey = p.user_id
"""


@query("build_match_prompt", MATCH_PROMPT_SQL)
def q_build_match_prompt(spark, sf):
    # a prompt for every posting that a profile's own search terms find
    from matchbook.plans.scorers import match_prompts
    docs = read_table(spark, sf, "documents")
    matches = textfilter.keyword_hits(docs.withColumnRenamed("doc_id", "job_hash"), keyword_table(spark, sf), "job_hash", "text")
    return match_prompts(None, fx.postings(spark, sf), fx.profiles(spark, sf), matches)


def _profile_slots_sql():
    return dict(sectors="c_mktsegment", titles=_TITLES_SQL, skills=_SKILLS_SQL,
                education=f"coalesce({EDU_SQL}, 'unknown')",
                experience=f"coalesce({EXP_SQL}, 'unknown')")


PROFILE_PROMPTS_SQL = f"""
SELECT c_custkey AS user_id,
       {KEYWORD_PROMPT.sql(**_profile_slots_sql())} AS keyword_prompt,
       {IDEAL_JOB_PROMPT.sql(**_profile_slots_sql())} AS ideal_job_prompt
FROM customer
"""


@query("build_profile_prompts", PROFILE_PROMPTS_SQL)
def q_build_profile_prompts(spark, sf):
    from matchbook.operators.generators import profile_prompt_slots
    p = fx.profiles(spark, sf)
    return p.select("user_id",
                    KEYWORD_PROMPT.column(**profile_prompt_slots(", ")).alias("keyword_prompt"),
                    IDEAL_JOB_PROMPT.column(**profile_prompt_slots(" or ")).alias("ideal_job_prompt"))


PARSE_SQL = """
SELECT l.doc_id AS job_hash, (l.quality * 10)::INTEGER AS llm_score, 'toxic=' || l.toxic::VARCHAR AS llm_comment,
       true AS reply_valid, '1.0.0' AS llm_version, split_part(d.text, chr(10), 1) AS title
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""


@query("parse_llm_response", PARSE_SQL)
def q_parse_llm_response(spark, sf):
    from matchbook.operators.scoring import SCORER_VERSION
    lab = read_table(spark, sf, "labels")
    replies = lab.select(F.col("doc_id").alias("job_hash"),
                         F.to_json(F.struct((F.col("quality") * 10).alias("score"),
                                            F.concat(F.lit("toxic="), F.col("toxic").cast("string"))
                                             .alias("justification"))).alias("reply"))
    parsed = parse_replies(replies).withColumn("llm_version", F.lit(SCORER_VERSION))
    info = fx.postings(spark, sf).select("job_hash", "title")
    return parsed.join(info, "job_hash").select(
        "job_hash", "llm_score", "llm_comment", "reply_valid", "llm_version", "title")


def _stub_vectors_sql(name: str, src: str, keys: str, dim: int = 64) -> str:
    """CTEs ``{name}_c(keys, idx, v)`` and ``{name}_n(keys, nrm)``: the
    offline embedder's sentence vectors (mean of signed one-hot token
    vectors, float32) in sparse form, from ``src(keys, text)``."""
    return f"""
{name}_t AS (SELECT {keys}, len(toks) AS n, toks
             FROM (SELECT {keys}, {T.tokenize_sql_duckdb("text")} AS toks FROM {src})),
{name}_c AS (
  SELECT {keys}, idx, ((sum(sgn)::DOUBLE / any_value(n))::FLOAT)::DOUBLE AS v FROM (
    SELECT {keys}, n, ('0x' || substr(md5(tok), 1, 8))::UBIGINT % {dim} AS idx,
           CASE WHEN (('0x' || substr(md5(tok), 9, 2))::INTEGER & 1) = 1 THEN 1 ELSE -1 END AS sgn
    FROM (SELECT {keys}, n, unnest(toks) AS tok FROM {name}_t))
  GROUP BY ALL),
{name}_n AS (SELECT {keys}, sqrt(sum(v * v)) AS nrm FROM {name}_c GROUP BY ALL)"""


def _offline_scorers_sql(pairs: str, posts: str, kw: str) -> str:
    """CTEs ``fast`` and ``llm``: what the registry's two scorers return with
    the offline stubs, for ``pairs(user_id, job_hash)``,
    ``posts(job_hash, title, company, description, lang)`` and
    ``kw(user_id, what_or, what_exclude)`` (profiles derived from the search
    terms, the search terms as the reference text)."""
    prompt = MATCH_PROMPT.sql(
        titles="array_to_string(string_split(k.what_or, ' '), ', ')",
        ideal_job="coalesce(k.what_or, '')", skills="'search'",
        education=f"coalesce({dims.map_sql_duckdb(dims.EDUCATION_LABELS, '1')}, 'unknown')",
        experience=f"coalesce({dims.map_sql_duckdb(dims.EXPERIENCE_LABELS, '1')}, 'unknown')",
        job_title="coalesce(d.title, '')", company="coalesce(d.company, '')",
        description="substr(coalesce(d.description, ''), 1, 1000)")
    routed = f"lower(lang) IN ('fr', 'en') AND job_hash IN (SELECT job_hash FROM {pairs})"
    return f"""
jt AS (SELECT job_hash, 'description' AS field, description AS text FROM {posts} WHERE {routed}
       UNION ALL
       SELECT job_hash, 'title' AS field, title AS text FROM {posts} WHERE {routed}),
rt AS (SELECT user_id, 'description' AS field, what_or AS text FROM {kw}
       UNION ALL
       SELECT user_id, 'title' AS field, what_or AS text FROM {kw}),
{_stub_vectors_sql("jv", "jt", "job_hash, field")},
{_stub_vectors_sql("rv", "rt", "user_id, field")},
pf AS (SELECT p.user_id, p.job_hash, jt.field FROM {pairs} p JOIN jt ON jt.job_hash = p.job_hash),
dots AS (SELECT pf.user_id, pf.job_hash, pf.field, sum(j.v * r.v) AS dot
         FROM pf JOIN jv_c j ON j.job_hash = pf.job_hash AND j.field = pf.field
                 JOIN rv_c r ON r.user_id = pf.user_id AND r.field = pf.field AND r.idx = j.idx
         GROUP BY ALL),
sims AS (SELECT pf.user_id, pf.job_hash,
                CASE WHEN jn.nrm > 0 AND rn.nrm > 0 THEN coalesce(dots.dot, 0) / (jn.nrm * rn.nrm) END AS sim
         FROM pf LEFT JOIN dots USING (user_id, job_hash, field)
                 LEFT JOIN jv_n jn ON jn.job_hash = pf.job_hash AND jn.field = pf.field
                 LEFT JOIN rv_n rn ON rn.user_id = pf.user_id AND rn.field = pf.field),
fast AS (SELECT user_id, job_hash, 'FastText' AS implementation,
                CASE WHEN count(sim) = 2 THEN avg(sim) END AS score,
                NULL::VARCHAR AS comment, '1.0.0' AS version
         FROM sims GROUP BY user_id, job_hash),
lp AS (SELECT p.user_id, p.job_hash, {prompt} AS prompt
       FROM {pairs} p JOIN {kw} k ON k.user_id = p.user_id JOIN {posts} d ON d.job_hash = p.job_hash),
llm AS (SELECT user_id, job_hash, 'LLM' AS implementation,
               (('0x' || substr(md5(prompt), 1, 8))::UBIGINT % 11)::DOUBLE AS score,
               'offline score for ' || length(prompt)::VARCHAR || ' chars' AS comment, '1.0.0' AS version
        FROM lp)"""


SCORE_REGISTRY_SQL = f"""
WITH {KW_SQL},
kt AS (SELECT user_id, unnest(string_split(what_or, ' ')) AS term, false AS bad FROM kw
       UNION SELECT user_id, what_exclude, true FROM kw),
t AS (SELECT doc_id AS job_hash, unnest(list_distinct({T.tokenize_sql_duckdb("text")})) AS term FROM documents),
pairs AS (SELECT kt.user_id, t.job_hash FROM t JOIN kt ON kt.term = t.term AND kt.term <> ''
          GROUP BY ALL HAVING bool_or(NOT bad) AND NOT bool_or(bad)),
posts AS (SELECT doc_id AS job_hash, split_part(text, chr(10), 1) AS title, source AS company,
                 text AS description, lang FROM documents),
{_offline_scorers_sql("pairs", "posts", "kw")}
SELECT * FROM fast UNION ALL SELECT * FROM llm
"""


@query("score_with_registry", SCORE_REGISTRY_SQL)
def q_score_with_registry(spark, sf):
    from matchbook.plans.scorers import default_registry
    reg = default_registry()
    fast, llm = reg.get("FastText"), reg.get("LLM")   # validated before any job
    docs = read_table(spark, sf, "documents")
    kw = keyword_table(spark, sf)
    matches = textfilter.keyword_hits(docs.withColumnRenamed("doc_id", "job_hash"), kw, "job_hash", "text")
    pairs, posts = matches.pairs(), fx.postings(spark, sf)
    ref_texts = kw.select("user_id", F.explode(F.array(*[F.lit(f) for f in ("description", "title")]))
                          .alias("field"), F.col("what_or").alias("text"))
    kw_profiles = kw.select("user_id", F.split("what_or", " ").alias("job_titles"),
                            F.col("what_or").alias("ideal_job"),
                            F.array(F.struct(F.lit("search").alias("name"),
                                             F.lit(100).alias("weight_pct"))).alias("technical_skills"),
                            F.lit(1).alias("education"), F.lit(1).alias("experience"))
    return fast(pairs, posts, ref_texts, matches=matches).unionByName(llm(pairs, posts, kw_profiles, matches=matches))


# --- persistence ------------------------------------------------------------------

UPSERT_SQL = """
WITH o AS (SELECT doc_id AS job_hash, quality AS llm_score, toxic::DOUBLE AS fasttext_score,
                  'quality ' || quality::VARCHAR AS llm_comment, '1.0.0' AS llm_version,
                  '1.0.0' AS fasttext_version FROM labels),
n AS (SELECT doc_id AS job_hash, n_chars / 40000.0 AS fasttext_score,
             '1.1.0' AS fasttext_version FROM documents WHERE lang = 'fr')
SELECT coalesce(n.job_hash, o.job_hash) AS job_hash, o.llm_score,
       CASE WHEN n.job_hash IS NOT NULL THEN n.fasttext_score ELSE o.fasttext_score END AS fasttext_score,
       o.llm_comment, o.llm_version,
       CASE WHEN n.job_hash IS NOT NULL THEN n.fasttext_version ELSE o.fasttext_version END AS fasttext_version
FROM o FULL OUTER JOIN n ON o.job_hash = n.job_hash
"""


@query("upsert_partial_columns", UPSERT_SQL)
def q_upsert_partial_columns(spark, sf):
    old = fx.reviews(spark, sf).select(
        "job_hash", "llm_score", "fasttext_score",
        F.concat(F.lit("quality "), F.col("llm_score").cast("string")).alias("llm_comment"),
        F.lit("1.0.0").alias("llm_version"), F.lit("1.0.0").alias("fasttext_version"))
    d = read_table(spark, sf, "documents")
    new = d.where(F.col("lang") == "fr").select(
        F.col("doc_id").alias("job_hash"),
        (F.col("n_chars") / 40000.0).alias("fasttext_score"),
        F.lit("1.1.0").alias("fasttext_version"))
    return upsert(old, new, ["job_hash"])


# --- profile analytics -------------------------------------------------------------

PROFILE_VALID_SQL = """
WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total_weight, sum(l_linenumber) AS family_weight, count(*) AS n_skills,
                  bool_or(coalesce(l_quantity NOT BETWEEN 0 AND 45, true)) AS beyond
           FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, t.total_weight, coalesce(t.n_skills, 0) AS n_skills,
       v = '' AS is_valid, v AS violations
FROM (SELECT o.*, concat_ws(',',
        CASE WHEN coalesce(t.total_weight <> 100, true) THEN 'technical_total' END,
        CASE WHEN coalesce(t.family_weight <> 100, true) THEN 'family_total' END,
        CASE WHEN trim(coalesce(o.o_orderpriority, '')) = '' THEN 'missing_priority' END,
        CASE WHEN trim(regexp_replace(o.o_orderstatus, '[FO]', '')) = '' THEN 'missing_status' END,
        CASE WHEN coalesce(t.beyond, true) THEN 'weight_quantity' END) AS v
      FROM orders o LEFT JOIN t ON t.l_orderkey = o.o_orderkey) o
LEFT JOIN t ON t.l_orderkey = o.o_orderkey
"""


@query("profile_validation", PROFILE_VALID_SQL)
def q_profile_validation(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    totals = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("total_weight"), F.sum("l_linenumber").alias("family_weight"),
        F.count(F.lit(1)).alias("n_skills"),
        F.max(weight_out_of_bounds("l_quantity", high=45)).alias("beyond"))
    prof = o.join(totals, "o_orderkey", "left").withColumn("n_skills", F.coalesce("n_skills", F.lit(0)))
    rules = standard_rules(
        F.col("total_weight"), F.col("family_weight"),
        required={"priority": F.col("o_orderpriority"),
                  "status": F.regexp_replace("o_orderstatus", "[FO]", "")})      # closed and open ones are left blank
    rules["weight_quantity"] = F.col("beyond")
    checked = validate_profiles(prof, rules)
    return checked.select("o_orderkey", "total_weight", "n_skills", "is_valid",
                          F.array_join("violations", ",").alias("violations"))


SHARE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
       round(100.0 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share_pct
FROM lineitem
"""


@query("skill_share", SHARE_SQL)
def q_skill_share(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return skill_share(li, "l_orderkey", "l_quantity").withColumn("share_pct", F.round("share_pct", 6))


_SECTOR_VALUES = ", ".join("('" + "', '".join(v.replace("'", "''") for v in row) + "')"
                           for row in dims.SECTORS)
_SEG_SQL = dims.map_sql_duckdb(fx.SEGMENT_SECTOR, "c_mktsegment")
DIM_SQL = f"""
WITH s(category, core_idea, examples, icon) AS (VALUES {_SECTOR_VALUES})
SELECT c.c_custkey AS user_id, (c.c_nationkey % 4) AS education, {EDU_SQL} AS education_label,
       (c.c_nationkey % 5) AS experience, {EXP_SQL} AS experience_label,
       (c.c_nationkey % 4) AS education_roundtrip,
       {_SEG_SQL} AS sector, concat_ws(' ', s.icon, {_SEG_SQL}) AS sector_display, s.core_idea
FROM customer c LEFT JOIN s ON s.category = {_SEG_SQL}
"""


@query("dimension_labels", DIM_SQL)
def q_dimension_labels(spark, sf):
    p = fx.profiles(spark, sf)
    sector = dims.code_to_label("segment", fx.SEGMENT_SECTOR)
    x = (p.withColumn("segment", F.element_at("sectors", 1))
          .withColumn("sector", sector)
          .join(F.broadcast(dims.sector_dim(spark)), F.col("sector") == F.col("category"), "left"))
    edu = dims.education_label("education")
    return x.select("user_id", "education", edu.alias("education_label"), "experience",
                    dims.experience_label("experience").alias("experience_label"),
                    dims.label_to_code(edu, dims.EDUCATION_LABELS).alias("education_roundtrip"),
                    "sector", dims.with_icon(F.col("icon"), F.col("sector")).alias("sector_display"),
                    "core_idea")


RATING_SQL = """
SELECT user_id, job_hash, score, applied, comment FROM (
  SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS job_hash, (1 + event_id % 10)::INTEGER AS score,
         event_type = 'purchase' AS applied, event_type AS comment, ts, event_id
  FROM events WHERE event_type <> 'view')
QUALIFY row_number() OVER (PARTITION BY user_id, job_hash ORDER BY ts DESC, event_id DESC) = 1
"""


@query("rating_projection", RATING_SQL)
def q_rating_projection(spark, sf):
    from matchbook.operators.ratings import rating_rows
    e = read_table(spark, sf, "events")
    shown = e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("job_hash"),
                     "ts", "event_id",
                     (F.col("event_type") != "view").alias("wants_to_rate"),
                     (1 + F.col("event_id") % 10).cast("int").alias("score"),
                     (F.col("event_type") == "purchase").alias("applied"),
                     F.col("event_type").alias("comment"))
    return rating_rows(shown).select("user_id", "job_hash", "score", "applied", "comment")


PREVIEW_SQL = """
SELECT doc_id AS job_hash,
       coalesce(split_part(text, chr(10), 1), 'Unknown Title') || ' at ' || coalesce(nullif(source, 'src0'), 'Unknown Company') AS card_title,
       coalesce(substr(strftime(DATE '2024-01-01' + (doc_id % 60)::INTEGER, '%Y-%m-%d'), 1, 10), 'N/A') AS posted,
       coalesce(upper(lang), 'N/A') AS location,
       substr(coalesce(text, 'No description available.'), 1, 500) || '...' AS preview
FROM documents
"""


@query("preview_cards", PREVIEW_SQL)
def q_preview_cards(spark, sf):
    from matchbook.operators.ratings import preview_cards
    p = fx.postings(spark, sf).withColumn("company", F.nullif("company", F.lit("src0"))) \
        .withColumn("location", F.upper("lang"))
    return preview_cards(p).select("job_hash", "card_title", "posted", "location", "preview")


# --- cooldown -----------------------------------------------------------------------

COOLDOWN_SECONDS = 300
COOLDOWN_SQL = f"""
WITH RECURSIVE req AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END AS implementation,
         row_number() OVER (PARTITION BY user_id,
                            CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END
                            ORDER BY ts, event_id) AS rn
  FROM events),
walk AS (
  SELECT user_id, implementation, rn, event_id, ts, ts AS last_ts, true AS accepted FROM req WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.implementation, r.rn, r.event_id, r.ts,
         CASE WHEN r.ts >= w.last_ts + INTERVAL {COOLDOWN_SECONDS} SECOND THEN r.ts ELSE w.last_ts END,
         r.ts >= w.last_ts + INTERVAL {COOLDOWN_SECONDS} SECOND
  FROM walk w JOIN req r
    ON r.user_id = w.user_id AND r.implementation = w.implementation AND r.rn = w.rn + 1)
SELECT user_id, implementation, event_id, accepted,
       CASE WHEN NOT accepted
            THEN floor(({COOLDOWN_SECONDS} - (epoch(ts) - epoch(last_ts))) / 60)::BIGINT END AS wait_minutes
FROM walk
"""


@query("cooldown_accept", COOLDOWN_SQL)
def q_cooldown_accept(spark, sf):
    req = fx.scoring_requests(spark, sf)
    out = cooldown_accept(req, ["user_id", "implementation"], "ts", "event_id", COOLDOWN_SECONDS)
    return out.select("user_id", "implementation", "event_id", "accepted", "wait_minutes")


# --- streams ------------------------------------------------------------------------

def _event_stream(spark, sf):
    from matchbook.streaming.runner import read_stream_table
    schema = read_table(spark, sf, "events").schema
    return read_stream_table(spark, f"{sf.rstrip('/')}/events*.parquet", schema)


def _requests_of(events):
    impl = F.when(F.col("event_type").isin("click", "view"), "FastText").otherwise("LLM")
    return events.select("event_id", "user_id", impl.alias("implementation"), "ts")


@query("cooldown_accept_stream", COOLDOWN_SQL)
def q_cooldown_accept_stream(spark, sf):
    from matchbook.streaming.cooldown_stream import cooldown_stream
    from matchbook.streaming.runner import run_to_table
    s = cooldown_stream(_requests_of(_event_stream(spark, sf)), ["user_id", "implementation"],
                        "ts", "event_id", COOLDOWN_SECONDS)
    return run_to_table(s, "cooldown").select("user_id", "implementation", "event_id", "accepted",
                                              "wait_minutes")


# A landed file arrives in its row order (event_id order for events) and is
# one micro-batch, inside which the watermark is not yet set: the first
# arrival of each key survives and nothing is late.
INGEST_SQL = f"""
SELECT job_hash, event_id, user_id, event_type FROM (
  SELECT *, {_hash_sql("user_id::VARCHAR", "event_type", "ts")} AS job_hash FROM events)
QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY event_id) = 1
"""


@query("ingest_dedup_stream", INGEST_SQL)
def q_ingest_dedup_stream(spark, sf):
    from matchbook.streaming.ingest_stream import dedup_stream
    from matchbook.streaming.runner import run_to_table
    ev = _event_stream(spark, sf)
    keyed = ev.withColumn("job_hash", identity.job_hash(F.col("user_id").cast("string"),
                                                        F.col("event_type"), F.col("ts")))
    return run_to_table(dedup_stream(keyed, ["job_hash"], "ts", "1 day"), "ingest").select(
        "job_hash", "event_id", "user_id", "event_type")


WINDOW_DELAY_SECONDS = 3600
WINDOW_COUNTS_SQL = f"""
WITH r AS (SELECT ts, CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END AS implementation
           FROM events),
wm AS (SELECT max(ts) - INTERVAL {WINDOW_DELAY_SECONDS} SECOND AS watermark FROM events)
SELECT CAST(r.ts AS DATE) AS window_day, r.implementation, count(*) AS n_requests
FROM r JOIN wm ON CAST(r.ts AS DATE) + INTERVAL 1 DAY <= wm.watermark
GROUP BY ALL
"""


@query("request_window_counts", WINDOW_COUNTS_SQL)
def q_request_window_counts(spark, sf):
    # Requests per day and implementation as a stream.  Append mode
    # emits a window once the watermark (latest event time minus the delay)
    # has passed its end, so the still-open last day is held back.
    from matchbook.streaming.ingest_stream import window_counts
    from matchbook.streaming.runner import run_to_table
    s = window_counts(_requests_of(_event_stream(spark, sf)), "implementation", "ts", "1 day",
                      f"{WINDOW_DELAY_SECONDS} seconds")
    return run_to_table(s, "window-counts").select(F.to_date("window_start").alias("window_day"),
                                                   "implementation", "n_requests")


# One landed request file is one micro-batch (epoch 0).  FastText requests get
# the flagship ranking of unseen postings, LLM requests the postings the text
# model has already scored for the user, best first.
REQUEST_STREAM_SQL = f"""
WITH {JV_SQL},
{USER_SEEN_SQL},
req AS (SELECT DISTINCT user_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'FastText' ELSE 'LLM' END AS implementation
        FROM events),
ready AS (SELECT user_id FROM refs WHERE vec IS NOT NULL GROUP BY user_id
          HAVING count(DISTINCT field || lang) = 4),
sims AS (
  SELECT r.user_id, j.job_hash, list_cosine_similarity(j.vec, r.vec) AS sim
  FROM jv j JOIN refs r USING (field, lang)
  WHERE j.job_hash IN (SELECT doc_id FROM documents) AND r.user_id IN (SELECT user_id FROM ready)
    AND r.user_id IN (SELECT user_id FROM req WHERE implementation = 'FastText')
    AND (r.user_id, j.job_hash) NOT IN (SELECT (user_id, job_hash) FROM seen)),
scores AS (
  SELECT 'FastText' AS implementation, user_id, job_hash, CASE WHEN count(sim) = 2 THEN avg(sim) END AS score
  FROM sims GROUP BY ALL
  UNION ALL
  SELECT 'LLM', user_id, job_hash, max(llm_score)::DOUBLE FROM user_reviews
  WHERE llm_score IS NOT NULL AND job_hash IN (SELECT doc_id FROM documents)
    AND user_id IN (SELECT user_id FROM req WHERE implementation = 'LLM')
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY implementation, user_id
                               ORDER BY score DESC NULLS LAST, job_hash) AS rk
  FROM scores)
SELECT implementation, 0 AS epoch_id, user_id, rk::INTEGER AS rank, job_hash, round(score, 6) AS score
FROM ranked WHERE rk <= 10
"""


@query("scoring_request_stream", REQUEST_STREAM_SQL)
def q_scoring_request_stream(spark, sf):
    from matchbook.operators.ranking import top_jobs
    from matchbook.streaming.request_stream import serve_requests
    from matchbook.streaming.runner import run_foreach_batch, stream_dirs
    out, _ = stream_dirs(spark, "requests-out")
    posts, vecs = fx.postings(spark, sf), fx.job_field_vectors(spark, sf)
    refs, revs = fx.user_reference_vectors(spark, sf), fx.user_reviews(spark, sf)

    def by_vectors(users):
        return recommend(posts, vecs, refs, revs, "FastText", 10, users=users).select(
            "user_id", "rank", "job_hash", "score")

    def by_reviews(users):
        # postings the text model has scored for the user, from the review store
        mine = revs.join(users.select(F.col("user_id").cast("int").alias("user_id")), "user_id", "left_semi")
        best = mine.groupBy("user_id", "job_hash").agg(F.max("llm_score").alias("llm_score"))
        return top_jobs(best, posts, "LLM", 10, ()).select(
            "user_id", F.col("rank").cast("int").alias("rank"), "job_hash", F.col("llm_score").cast("double").alias("score"))

    run_foreach_batch(_requests_of(_event_stream(spark, sf)), "requests",
                      serve_requests(None, {"FastText": by_vectors, "LLM": by_reviews}, out))
    return spark.read.parquet(out).select("implementation", "epoch_id", "user_id", "rank",
                                          "job_hash", "score")


# The offline ideal-job generator: distinct prompt words longer than two
# characters, in first-seen order; slot (i, lang) picks 4 consecutive words
# from an MD5 offset; title = 2 words, description = "lang: " + 4 words.
BUILD_REFS_SQL = f"""
WITH p AS (SELECT c_custkey AS user_id, {IDEAL_JOB_PROMPT.sql(**_profile_slots_sql())} AS prompt
           FROM customer),
tw AS (SELECT user_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
       FROM (SELECT user_id, {T.tokenize_sql_duckdb("prompt")} AS toks FROM p)),
wl AS (SELECT user_id, list(w ORDER BY first_pos) AS words
       FROM (SELECT user_id, w, min(pos) AS first_pos FROM tw WHERE length(w) > 2 GROUP BY ALL)
       GROUP BY user_id),
slots AS (SELECT p.user_id, p.prompt, coalesce(wl.words, ['job']) AS words,
                 unnest([0, 0, 1, 1, 2, 2]) AS i, unnest(['fr', 'en', 'fr', 'en', 'fr', 'en']) AS lc
          FROM p LEFT JOIN wl ON wl.user_id = p.user_id),
picks AS (SELECT user_id, i, lc, words, n,
                 (('0x' || substr(md5(prompt || '|' || i::VARCHAR || '|' || lc), 1, 8))::UBIGINT % n)::BIGINT AS o
          FROM (SELECT *, len(words) AS n FROM slots)),
texts AS (SELECT user_id, upper(lc) AS lang, i, 'title' AS field,
                 words[o + 1] || ' ' || words[(o + 1) % n + 1] AS text FROM picks
          UNION ALL
          SELECT user_id, upper(lc) AS lang, i, 'description' AS field,
                 lc || ': ' || words[o + 1] || ' ' || words[(o + 1) % n + 1] || ' ' ||
                 words[(o + 2) % n + 1] || ' ' || words[(o + 3) % n + 1] AS text FROM picks),
{_stub_vectors_sql("tv", "texts", "user_id, lang, i, field")},
grp AS (SELECT user_id, field, lang, count(*) AS n_vectors FROM texts GROUP BY ALL),
comp AS (SELECT c.user_id, c.field, c.lang, c.idx, sum(c.v) / any_value(g.n_vectors) AS m
         FROM tv_c c JOIN grp g USING (user_id, field, lang) GROUP BY ALL),
agg AS (SELECT user_id, field, lang, sqrt(sum(m * m)) AS nrm, sum(m) AS vs FROM comp GROUP BY ALL)
SELECT g.user_id, g.field, g.lang, g.n_vectors, count(*) OVER (PARTITION BY g.user_id) = 4 AS ready,
       64 AS dim, round(coalesce(a.nrm, 0), 6) AS vec_norm, round(coalesce(a.vs, 0), 6) AS vec_sum
FROM grp g LEFT JOIN agg a USING (user_id, field, lang)
"""


@query("build_reference_embeddings", BUILD_REFS_SQL)
def q_build_reference_embeddings(spark, sf):
    # Entry 2 over every customer profile: generator (X4) -> provider
    # -> mean per (user, field, lang) (A1), then readiness (P17).  The norm
    # and the sum of each mean vector make its values part of the check.
    from matchbook.functions.vectors import norm
    from matchbook.operators.embedding import with_readiness
    from matchbook.operators.generators import build_reference_embeddings
    refs = build_reference_embeddings(fx.profiles(spark, sf))
    total = F.aggregate("vec", F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return with_readiness(refs).select("user_id", "field", "lang", "n_vectors", "ready",
                                       F.size("vec").alias("dim"),
                                       F.round(norm("vec"), 6).alias("vec_norm"),
                                       F.round(total, 6).alias("vec_sum"))


REVIEW_STORE_SCHEMA = ("user_id long, job_hash string, llm_score int, fasttext_score double, "
                       "llm_comment string, llm_version string, fasttext_version string")


SCORING_RUN_CTES = f"""
WITH {KW_SQL},
{RAW_POSTINGS_CTE},
clean AS (SELECT pos, redirect_url AS url, lower(description) AS description, lower(title) AS title,
                 TRY_CAST(substr(created, 1, 10) AS DATE) AS posted_date,
                 upper(coalesce(company_name, 'unknown')) AS company, lower(loc_name) AS lang
          FROM raw),
posts AS (SELECT job_hash, title, company, description, lang, url FROM (
            SELECT *, {_hash_sql("title", "company", "posted_date")} AS job_hash FROM clean)
          QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY pos, url) = 1),
kt AS (SELECT user_id, unnest(string_split(what_or, ' ')) AS term, false AS bad FROM kw
       UNION SELECT user_id, what_exclude, true FROM kw),
t AS (SELECT job_hash, unnest(list_distinct({T.tokenize_sql_duckdb("description")})) AS term FROM posts),
pairs AS (SELECT kt.user_id, t.job_hash FROM t JOIN kt ON kt.term = t.term AND kt.term <> ''
          GROUP BY ALL HAVING bool_or(NOT bad) AND NOT bool_or(bad)),
{_offline_scorers_sql("pairs", "posts", "kw")}
"""

SCORING_RUN_SQL = SCORING_RUN_CTES + """
SELECT coalesce(l.user_id, f.user_id) AS user_id, coalesce(l.job_hash, f.job_hash) AS job_hash,
       l.score::INTEGER AS llm_score, f.score AS fasttext_score, l.comment AS llm_comment,
       l.version AS llm_version, f.version AS fasttext_version
FROM llm l FULL OUTER JOIN fast f ON l.user_id = f.user_id AND l.job_hash = f.job_hash
"""


@query("scoring_run", SCORING_RUN_SQL)
def q_scoring_run(spark, sf):
    # Entry 1 twice over the landed postings: a FastText run into an empty
    # review store, then an LLM run into the result.  The LLM run must add
    # its columns to the same (user, posting) rows without erasing scores.
    from matchbook.plans.scoring_run import prepare_postings, score_postings
    raw = fx.raw_postings(spark, sf)
    kw = keyword_table(spark, sf)
    lang = F.lower(F.col("location"))
    empty = spark.createDataFrame([], REVIEW_STORE_SCHEMA)
    ref_texts = kw.select("user_id", F.explode(F.array(F.lit("description"), F.lit("title"))).alias("field"),
                          F.col("what_or").alias("text"))
    found = prepare_postings(raw, kw, lang, run_date=RUN_DATE)          # both runs score the same candidates
    _, after_fast, _ = score_postings(found, empty, "FastText", ref_texts=ref_texts)
    profiles = kw.select("user_id", F.split("what_or", " ").alias("job_titles"),
                         F.col("what_or").alias("ideal_job"),
                         F.array(F.struct(F.lit("search").alias("name"),
                                          F.lit(100).alias("weight_pct"))).alias("technical_skills"),
                         F.lit(1).alias("education"), F.lit(1).alias("experience"))
    _, after_llm, _ = score_postings(found, after_fast, "LLM", profiles=profiles)
    return after_llm


SCORING_REJECTS_SQL = SCORING_RUN_CTES + """
SELECT d.url, p.user_id, p.job_hash,
       CASE WHEN lower(d.lang) IN ('fr', 'en') THEN 'no_score' ELSE 'unsupported_language' END AS reason
FROM pairs p JOIN posts d ON d.job_hash = p.job_hash
LEFT JOIN fast f ON f.user_id = p.user_id AND f.job_hash = p.job_hash
WHERE f.score IS NULL
"""


@query("scoring_run_rejects", SCORING_REJECTS_SQL)
def q_scoring_run_rejects(spark, sf):
    # every candidate pair of the FastText run is scored or listed here
    from matchbook.plans.scoring_run import score_new_postings
    kw = keyword_table(spark, sf)
    ref_texts = kw.select("user_id", F.explode(F.array(F.lit("description"), F.lit("title"))).alias("field"),
                          F.col("what_or").alias("text"))
    return score_new_postings(fx.raw_postings(spark, sf), kw, spark.createDataFrame([], REVIEW_STORE_SCHEMA),
                              "FastText", F.lower(F.col("location")), run_date=RUN_DATE, ref_texts=ref_texts)[2]


# --- the stores around a run ----------------------------------------------------------

PAGE_SIZE = 50
LANDED_SQL = f"""
WITH {RAW_POSTINGS_CTE},
paged AS (SELECT *, pos // {PAGE_SIZE} + 1 AS page,
                 row_number() OVER (PARTITION BY pos // {PAGE_SIZE} ORDER BY pos) - 1 AS place FROM raw)
SELECT page::INTEGER AS page, place::INTEGER AS pos, redirect_url AS url, lower(title) AS title, lower(description) AS description,
       TRY_CAST(substr(created, 1, 10) AS DATE) AS posted_date, upper(coalesce(company_name, 'unknown')) AS company,
       loc_name AS location
FROM paged
"""


@query("landed_pages", LANDED_SQL)
def q_landed_pages(spark, sf):
    # the job board's answers, one JSON file a page, read back as one table
    from matchbook.session import ensure_checkpoint_dir
    from matchbook.sources.landing import land_pages, read_posting_pages
    raw = fx.raw_postings(spark, sf)
    root = land_pages(raw.withColumn("page", (F.floor(F.col("pos") / PAGE_SIZE) + 1).cast("int")), "page", "pos",
                      f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed")
    return clean.clean_postings(read_posting_pages(spark, root, multiline=False), run_date=RUN_DATE).select(
        "page", "pos", "url", "title", "description", "posted_date", "company", "location")


TOP_LISTS_SQL = f"""
WITH {USER_SEEN_SQL.strip()},
r AS (SELECT 'FastText' AS implementation, user_id, job_hash, max(fasttext_score) AS score FROM user_reviews
      WHERE fasttext_score IS NOT NULL GROUP BY ALL
      UNION ALL
      SELECT 'LLM', user_id, job_hash, max(llm_score)::DOUBLE FROM user_reviews WHERE llm_score IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY implementation, user_id ORDER BY score DESC, job_hash) AS rk FROM r)
SELECT implementation, user_id, rk::INTEGER AS rank, job_hash, score, split_part(d.text, chr(10), 1) AS title, d.source AS company
FROM ranked JOIN documents d ON d.doc_id = job_hash
WHERE rk <= 10
"""


@query("top_lists", TOP_LISTS_SQL)
def q_top_lists(spark, sf):
    # ranked lists from the review store with their posting info, saved and read
    from matchbook.operators.ranking import top_jobs
    from matchbook.operators.seen import SCORE_COLUMN
    from matchbook.session import ensure_checkpoint_dir
    from matchbook.sources.snapshots import save_top_lists
    store = (fx.user_reviews(spark, sf).groupBy("user_id", "job_hash")
               .agg(F.max("llm_score").alias("llm_score"), F.max("fasttext_score").alias("fasttext_score")))
    info = fx.postings(spark, sf)
    lists = None
    for name in IMPLEMENTATIONS:
        best = top_jobs(store, info, name, 10, ("title", "company")).select(
            F.lit(name).alias("implementation"), "user_id", F.col("rank").cast("int").alias("rank"), "job_hash",
            F.col(SCORE_COLUMN[name]).cast("double").alias("score"), "title", "company")
        lists = best if lists is None else lists.unionByName(best)
    path = save_top_lists(lists, f"{ensure_checkpoint_dir(spark).rstrip('/')}/top-lists-{uuid.uuid4().hex}")
    return spark.read.parquet(path).select("implementation", "user_id", "rank", "job_hash", "score", "title", "company")


RATING_STORE_SQL = f"""
WITH fresh AS ({RATING_SQL}),
store AS (SELECT (doc_id % 100)::BIGINT AS user_id, doc_id AS job_hash, quality AS score, 'kept' AS origin FROM labels)
SELECT coalesce(f.user_id, s.user_id) AS user_id, coalesce(f.job_hash, s.job_hash) AS job_hash,
       CASE WHEN f.user_id IS NOT NULL THEN f.score ELSE s.score END AS score, s.origin, f.applied, f.comment
FROM store s FULL OUTER JOIN fresh f ON s.user_id = f.user_id AND s.job_hash = f.job_hash
"""


@query("ratings_upsert", RATING_STORE_SQL)
def q_ratings_upsert(spark, sf):
    lab = read_table(spark, sf, "labels")
    store = lab.select((F.col("doc_id") % 100).alias("user_id"), F.col("doc_id").alias("job_hash"),
                       F.col("quality").alias("score"), F.lit("kept").alias("origin"))
    return upsert(store, q_rating_projection(spark, sf), ["user_id", "job_hash"])


JOB_INFO_SQL = SCORING_RUN_CTES + f""",
full_posts AS (SELECT * FROM (SELECT *, {_hash_sql("title", "company", "posted_date")} AS job_hash FROM (
                 SELECT pos, redirect_url AS url, lower(description) AS description, lower(title) AS title,
                        TRY_CAST(substr(created, 1, 10) AS DATE) AS posted_date,
                        upper(coalesce(company_name, 'unknown')) AS company, loc_name AS location FROM raw))
               QUALIFY row_number() OVER (PARTITION BY job_hash ORDER BY pos, url) = 1)
SELECT job_hash, title, company, description, location, posted_date, DATE '{RUN_DATE}' AS retrieved_date, url,
       CASE WHEN location = 'FR' THEN 'known' END AS note
FROM full_posts WHERE job_hash IN (SELECT job_hash FROM fast)
UNION ALL
SELECT 'only-' || job_hash, title, company, NULL, NULL, NULL, NULL, NULL, 'known' FROM full_posts WHERE location = 'DE'
"""


@query("job_info_upsert", JOB_INFO_SQL)
def q_job_info_upsert(spark, sf):
    # posting rows of a scoring run merged into the posting store: known
    # postings are renewed, columns the run does not bring are kept
    from matchbook.plans.scoring_run import score_new_postings
    kw = keyword_table(spark, sf)
    raw = fx.raw_postings(spark, sf)
    ref_texts = kw.select("user_id", F.explode(F.array(F.lit("description"), F.lit("title"))).alias("field"),
                          F.col("what_or").alias("text"))
    info, _, _ = score_new_postings(raw, kw, spark.createDataFrame([], REVIEW_STORE_SCHEMA), "FastText",
                                    F.lower(F.col("location")), run_date=RUN_DATE, ref_texts=ref_texts)
    info = info.select("job_hash", "title", "company", "description", "location", "posted_date", "retrieved_date", "url")
    posts = clean.clean_postings(raw, run_date=RUN_DATE).withColumn(
        "job_hash", identity.job_hash("title", "company", "posted_date"))
    posts = identity.dedup_first(posts.select("job_hash", "title", "company", "location", "pos", "url"), "job_hash", ["pos", "url"])
    known = (posts.where("location = 'FR'").join(info.select("job_hash"), "job_hash", "left_semi").select("job_hash", "title", "company")
                  .unionByName(posts.where("location = 'DE'").select(F.concat(F.lit("only-"), "job_hash").alias("job_hash"), "title", "company")))
    return upsert(known.withColumn("note", F.lit("known")), info, "job_hash").select(*info.columns, "note")


# Further queries register themselves on import.
from matchbook.plans import catalog_runs, catalog_stores, catalog_streams  # noqa: E402, F401
