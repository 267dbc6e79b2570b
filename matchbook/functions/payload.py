"""Raw payloads as VARIANT (P6, F9), and how their shape drifts between runs.

A posting's JSON is kept whole, so fields nobody has declared survive, and a field
is read out by path and type: a value of another type is NULL there and is listed
by :func:`drift_report` instead of getting lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 6                       # nesting that the path listing follows


def to_payload(json_text) -> Column:
    """VARIANT of a JSON text; NULL for a text that is no JSON."""
    return F.try_parse_json(json_text)


# the type a value must have of its own to be read as a kind
OWN_TYPE = {"string": "STRING", "boolean": "BOOLEAN",
            **dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double"), "NUMBER")}


def field(payload, path: str, kind: str) -> Column:
    """The value at ``path``, NULL when it is missing or of another type: the text
    ``"7"`` is no number."""
    value = F.try_variant_get(payload, path, kind)
    if kind not in OWN_TYPE:
        return value
    return F.when(_type_of(F.try_variant_get(payload, path, "variant")) == OWN_TYPE[kind], value)


def payload_paths(df: DataFrame, payload_col: str, group_cols=()) -> DataFrame:
    """Rows (group, path, type, n): how many payloads hold a value of ``type`` at
    ``path``.  Elements of a list share the path ``x[]``; ``n`` counts values.

    One level of nesting per step, in Spark: every step explodes the objects and
    lists the step before has found, so nothing but (path, type) leaves a task
    after map-side counting."""
    spark = df.sparkSession
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    level = df.select(*groups, F.lit("$").alias("path"), F.col(payload_col).alias("v"))
    seen = None
    for _ in range(MAX_DEPTH):
        here = level.where("v is not null").withColumn("type", _type_of("v"))
        counted = here.groupBy(*groups, "path", "type").agg(F.count(F.lit(1)).alias("n"))
        seen = counted if seen is None else seen.unionByName(counted)
        nested = here.where("type in ('OBJECT', 'ARRAY')")
        inner = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("key", "value"))
        step = F.when(F.col("type") == "ARRAY", F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "key"))
        level = inner.select(*groups, step.alias("path"), F.col("value").alias("v"))
    return seen.groupBy(*groups, "path", "type").agg(F.sum("n").alias("n"))


def _type_of(v) -> Column:
    """The value's own type; whole numbers and fractions are one (``NUMBER``)."""
    kind = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    return F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(kind)


def drift_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences between two path listings (path, type, n), rows (path, type,
    n_before, n_after, change): ``new path``, ``gone path``, and for a path of both
    ``new type`` or ``gone type``."""
    b, a = (x.where("type <> 'VOID'").select("path", "type", F.col("n").alias(f"n_{name}"))
            for x, name in ((before, "before"), (after, "after")))
    paths_b = b.select("path").distinct().withColumn("in_before", F.lit(True))
    paths_a = a.select("path").distinct().withColumn("in_after", F.lit(True))
    both = b.join(a, ["path", "type"], "full_outer").join(paths_b, "path", "left").join(paths_a, "path", "left")
    change = (F.when(F.col("n_before").isNull(), F.when(F.col("in_before"), "new type").otherwise("new path"))
               .when(F.col("n_after").isNull(), F.when(F.col("in_after"), "gone type").otherwise("gone path")))
    return both.withColumn("change", change).where("change is not null").select(
        "path", "type", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"),
        "change")
