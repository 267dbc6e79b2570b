"""Map the driver's tables onto the engine's concepts.

The driver tables are generic (documents, embeddings, labels, events,
customer, orders, lineitem).  These adapters derive the posting, vector,
review, profile and request views the operators expect, so every query
reads the given tables and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.operators.embedding import elementwise_mean
from matchbook.sources.tables import read_table, spread

# --- fixed values of the fixture mapping ------------------------------------
BASE_DATE = "2024-01-01"
DATE_SPREAD_DAYS = 60
EMBED_DIM = 64
# ---------------------------------------------------------------------------


def posted_date(doc_id: Column) -> Column:
    return F.date_add(F.to_date(F.lit(BASE_DATE)), (doc_id % DATE_SPREAD_DAYS).cast("int"))


def title(text: Column) -> Column:
    """A document's title is its first line, whatever its length."""
    return F.substring_index(text, "\n", 1)


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """documents as flat postings: ``job_hash = doc_id``.

    Projected before any spread, so a shuffle carries the derived columns a
    query uses rather than whole texts."""
    d = read_table(spark, sf, "documents", spread_scan=False)
    return spread(d.select(F.col("doc_id").alias("job_hash"),
                    title(F.col("text")).alias("title"),
                    F.col("source").alias("company"),
                    F.col("text").alias("description"),
                    F.col("lang"),
                    posted_date(F.col("doc_id")).alias("posted_date")))


def raw_postings(spark: SparkSession, sf: str) -> DataFrame:
    """documents as nested API records (what the job board returns).

    ``created`` carries a time and a UTC offset per language; a company is
    missing for one source, exercising the missing-value path.
    """
    d = read_table(spark, sf, "documents", spread_scan=False)
    hour = F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0")
    offset = (F.when(F.col("lang") == "fr", F.lit("+02:00"))
                .when(F.col("lang") == "de", F.lit("-05:00"))
                .otherwise(F.lit("Z")))
    created = F.concat(F.date_format(posted_date(F.col("doc_id")), "yyyy-MM-dd"),
                       F.lit("T"), hour, F.lit(":30:00"), offset)
    return spread(d.select(
        F.col("doc_id").alias("pos"),
        title(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        created.alias("created"),
        F.concat(F.lit("https://jobs.invalid/"), F.col("doc_id").cast("string")).alias("redirect_url"),
        F.struct(F.nullif(F.col("source"), F.lit("src0")).alias("display_name")).alias("company"),
        F.struct(F.upper("lang").alias("display_name"),
                 F.array(F.upper("lang"), F.col("source")).alias("area")).alias("location"),
    ))


def job_field_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as posting field vectors: job = vec_id div 2, even ids are
    descriptions, odd ids titles; even jobs are French, odd English."""
    e = read_table(spark, sf, "embeddings")
    job = F.expr("vec_id div 2")
    return e.select(job.alias("job_hash"),
                    F.when(F.col("vec_id") % 2 == 0, "description").otherwise("title").alias("field"),
                    F.when(job % 2 == 0, "FR").otherwise("EN").alias("lang"),
                    F.col("embedding").alias("vec"),
                    F.col("label"))


def user_reference_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Per (user = label, field, lang): element-wise mean of the vectors."""
    jv = job_field_vectors(spark, sf).withColumnRenamed("label", "user_id")
    return elementwise_mean(jv, ["user_id", "field", "lang"], "vec", dim=EMBED_DIM)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """labels as the AI-review store: llm_score = quality, fasttext_score = toxic."""
    lab = read_table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("job_hash"),
                      F.col("quality").alias("llm_score"),
                      F.col("toxic").cast("double").alias("fasttext_score"))


def user_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """labels as a review store of several users: review ``doc_id`` belongs to
    user ``doc_id div 3 % 8`` and is about posting ``doc_id div 2``."""
    lab = read_table(spark, sf, "labels")
    return lab.select(F.expr("doc_id div 3 % 8").cast("int").alias("user_id"), F.expr("doc_id div 2").alias("job_hash"),
                      F.col("quality").alias("llm_score"),
                      F.when(F.col("doc_id") % 5 != 0, F.col("toxic").cast("double")).alias("fasttext_score"))


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as token vectors: item = vec_id div 5, pos = vec_id % 5."""
    e = read_table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("item"), (F.col("vec_id") % 5).alias("pos"),
                    F.col("embedding").alias("vec"))


# --- profiles (customer) -----------------------------------------------------
# Fixture rule: each customer is a user profile; the market segment is the
# sector and the main skill, nation key gives the education/experience codes.
SEGMENT_SECTOR = {
    "AUTOMOBILE": "Manufacturing",
    "BUILDING": "Infrastructure & Transport",
    "FURNITURE": "Manufacturing",
    "HOUSEHOLD": "Services & Commerce",
    "MACHINERY": "Manufacturing",
}


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.array(F.col("c_name"), F.concat(F.initcap(seg), F.lit(" specialist"))).alias("job_titles"),
        F.concat(F.lit("Hands-on "), F.lower(seg), F.lit(" work")).alias("ideal_job"),
        F.array(F.struct(F.initcap(seg).alias("name"), F.lit(60).alias("weight_pct")),
                F.struct(F.lit("Spark").alias("name"), F.lit(40).alias("weight_pct"))).alias("technical_skills"),
        (F.col("c_nationkey") % 4).alias("education"),
        (F.col("c_nationkey") % 5).alias("experience"),
        F.array(seg).alias("sectors"),
    )


def scoring_requests(spark: SparkSession, sf: str) -> DataFrame:
    """events as scoring requests: click/view ask for FastText, others LLM."""
    e = read_table(spark, sf, "events")
    impl = F.when(F.col("event_type").isin("click", "view"), "FastText").otherwise("LLM")
    return e.select("event_id", "user_id", impl.alias("implementation"), "ts")
