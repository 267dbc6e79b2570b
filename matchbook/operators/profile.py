"""Profile validation and skill analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED_TOTAL = 100


def array_weight_total(skills, weight_field: str = "weight_pct") -> Column:
    """Sum of ``weight_field`` over an ARRAY<STRUCT> column (A4, nested form)."""
    c = F.col(skills) if isinstance(skills, str) else skills
    return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[weight_field], F.lit(0)))


def weight_totals(skills: DataFrame, profile_key, weight_col: str) -> DataFrame:
    """Total weight and skill count per profile (A4, long form)."""
    keys = [profile_key] if isinstance(profile_key, str) else list(profile_key)
    return skills.groupBy(*keys).agg(F.sum(weight_col).alias("total_weight"),
                                     F.count(F.lit(1)).alias("n_skills"))


def skill_share(skills: DataFrame, profile_key, weight_col: str, out_col: str = "share_pct") -> DataFrame:
    """Each skill's percentage of its profile's total weight (A5).

    Totals come from a map-side-combined aggregate joined back on the key
    (not a window over the key), so a huge profile does not end up whole in
    one task; AQE splits a skewed join partition.  A zero total gives NULL.
    """
    keys = [profile_key] if isinstance(profile_key, str) else list(profile_key)
    totals = skills.groupBy(*keys).agg(F.sum(weight_col).alias("_total"))
    return (skills.join(totals, keys)
                  .withColumn(out_col, F.try_divide(F.col(weight_col) * 100.0, F.col("_total")))
                  .drop("_total"))


def validate_profiles(profiles: DataFrame, rules: dict) -> DataFrame:
    """Add ``violations ARRAY<STRING>`` and ``is_valid`` from named rules.

    ``rules`` maps a violation name to a boolean Column that is TRUE when
    the rule is broken.  NULL counts as broken (a rule that cannot be
    checked does not pass).
    """
    flags = [F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    return (profiles.withColumn("violations", F.array_compact(F.array(*flags)))
                    .withColumn("is_valid", F.size("violations") == 0))


def is_missing(col: Column) -> Column:
    """NULL, a text of white space only, or an array without elements (every
    such value is written as ``[]``, blanks or nothing)."""
    return F.coalesce(F.trim(F.regexp_replace(col.cast("string"), r"^\[\s*\]$|\s+", "")) == "", F.lit(True))


def weight_out_of_bounds(weight, low: int = 0, high: int = REQUIRED_TOTAL) -> Column:
    """Whether one weight is missing or outside ``low`` to ``high``: ``max`` of it
    over a profile's rows says the same as :func:`out_of_bounds` of their array."""
    c = F.col(weight) if isinstance(weight, str) else weight
    return ~F.coalesce(c.between(low, high), F.lit(False))


def out_of_bounds(skills, weight_field: str = "weight_pct", low: int = 0, high: int = REQUIRED_TOTAL) -> Column:
    """Whether any weight of an ARRAY<STRUCT> column is missing or outside
    ``low`` to ``high``."""
    c = F.col(skills) if isinstance(skills, str) else skills
    return F.exists(c, lambda x: weight_out_of_bounds(x[weight_field], low, high))


def standard_rules(tech_total: Column, family_total: Column | None = None,
                   required: dict | None = None, required_total: int = REQUIRED_TOTAL,
                   weights: dict | None = None) -> dict:
    """The profile form's rules: weight totals equal ``required_total``,
    required fields present (non-NULL and non-empty), and each weight of the
    ``weights`` arrays between 0 and the total."""
    rules = {"technical_total": tech_total != required_total}
    if family_total is not None:
        rules["family_total"] = family_total != required_total
    for name, col in (required or {}).items():
        rules[f"missing_{name}"] = is_missing(col)
    for name, col in (weights or {}).items():
        rules[f"weight_{name}"] = out_of_bounds(col)
    return rules
