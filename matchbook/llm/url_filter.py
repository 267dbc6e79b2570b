"""URL rules by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions a rule could be written as
(``host suffix + path prefix``, only the label counts and prefix lengths that
occur among the rules, so the expansion is bounded by the rule set and exact).
Expressions meet the rules in an equi-join on a short hash prefix; the full
digest confirms, and the longest fitting rule wins.  Each distinct URL is
judged once; copies of one URL share the verdict through a join whose right
side has one row per URL, so a hot URL is combined before the shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path
and gets the default verdict; a rule needs its path to be a prefix of the
URL's (an empty path does not start with ``/``); equal lengths prefer the
longer host, then ``block``.  Duplicate rows each get a row back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import broadcast_if_fits, lower_az, table

HASH_PREFIX_CHARS = 8          # hex characters, i.e. 32 bits
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
         ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_SCHEMA = "rule_host string, rule_path string, verdict string"


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(urls: DataFrame, label_counts: list[int], path_lengths: list[int]) -> DataFrame:
    """Rows (url, expr): the host suffixes of the given label counts, each with
    the path prefixes of the given lengths."""
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in label_counts]), lambda n: n <= F.size("_labels")),
        lambda n: F.array_join(F.slice(F.col("_labels"), F.size("_labels") - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length("_path")),
        lambda n: F.substring(F.col("_path"), F.lit(1), n))
    return (urls.withColumn("_labels", labels)
                .withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
                .select("_url", F.concat("_suffix", F.lit("/"), "_prefix").alias("_expr")))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow", prefix_chars: int = HASH_PREFIX_CHARS) -> DataFrame:
    """``pages`` plus host, path, rule (null when none fits) and verdict.

    Columns of ``pages`` named like an output are replaced by it.
    """
    rules = rules.filter("rule_host is not null and rule_path is not null").dropDuplicates()
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    known = rules.select(
        F.concat("rule_host", F.lit("/"), "rule_path").alias("_rule_expr"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("len"),
                 F.length("rule_host").alias("host_len"), F.col("verdict").alias("v"),
                 F.concat("rule_host", "rule_path").alias("r")).alias("_best"))
    known = known.select(F.sha2("_rule_expr", 256).alias("_digest"), "_best")
    known = known.select(F.substring("_digest", 1, prefix_chars).alias("_short"), "_digest", "_best")
    known = broadcast_if_fits(known)
    urls = (pages.select(F.col(url_col).alias("_url")).filter(F.col("_url").isNotNull()).distinct()
                 .select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")))
    exprs = expressions(urls, shape["labels"] or [0], shape["lengths"] or [0])
    exprs = exprs.select("_url", F.sha2("_expr", 256).alias("_full"))
    exprs = exprs.withColumn("_short", F.substring("_full", 1, prefix_chars))
    best = (exprs.join(known, "_short").filter(F.col("_full") == F.col("_digest"))
                 .groupBy("_url").agg(F.max("_best").alias("_best")))
    url = F.col(url_col)
    out = pages.join(best, pages[url_col] == best["_url"], "left")
    return (out.withColumns({"host": host_of(url), "path": path_of(url), "rule": F.col("_best.r"),
                             "verdict": F.coalesce("_best.v", F.lit(default))})
               .drop("_url", "_best"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, r, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (SELECT p.*, (SELECT arg_max(h || r || ' ' || v, length(h || r)) FROM rules
                   WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)) AS best
      FROM p)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
       coalesce(split_part(best, ' ', 2), 'allow') AS verdict
FROM j
"""
