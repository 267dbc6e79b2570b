"""Declared schemas (no inference on the hot path)."""

from pyspark.sql import types as T

RAW_POSTING = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("redirect_url", T.StringType()),
    T.StructField("company", T.StructType([T.StructField("display_name", T.StringType())])),
    T.StructField("location", T.StructType([
        T.StructField("display_name", T.StringType()),
        T.StructField("area", T.ArrayType(T.StringType())),
    ])),
])

# One landed API response page: {"results": [posting, ...]}
POSTING_PAGE = T.StructType([T.StructField("results", T.ArrayType(RAW_POSTING))])

AI_REVIEW = T.StructType([
    T.StructField("job_hash", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("llm_score", T.IntegerType()),
    T.StructField("fasttext_score", T.DoubleType()),
    T.StructField("llm_comment", T.StringType()),
    T.StructField("llm_version", T.StringType()),
    T.StructField("fasttext_version", T.StringType()),
])

USER_REVIEW = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("job_hash", T.StringType(), False),
    T.StructField("score", T.IntegerType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("comment", T.StringType()),
])

REF_EMBEDDING = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("lang", T.StringType(), False),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

SKILL = T.StructType([T.StructField("name", T.StringType()), T.StructField("weight_pct", T.IntegerType())])
FAMILY = T.StructType([T.StructField("category", T.StringType()), T.StructField("weight_pct", T.IntegerType())])

USER_PROFILE = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("job_titles", T.ArrayType(T.StringType())),
    T.StructField("ideal_job", T.StringType()),
    T.StructField("technical_skills", T.ArrayType(SKILL)),
    T.StructField("general_skills", T.ArrayType(FAMILY)),
    T.StructField("education", T.IntegerType()),
    T.StructField("experience", T.IntegerType()),
    T.StructField("sectors", T.ArrayType(T.StringType())),
])

SCORING_REQUEST = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("implementation", T.StringType(), False),
    T.StructField("ts", T.TimestampType()),
])
