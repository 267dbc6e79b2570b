"""Ratings and ranked-list presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions import text as T
from matchbook.operators.identity import latest_per_key

# --- fixed values -----------------------------------------------------------
DEFAULT_TITLE = "Unknown Title"
DEFAULT_COMPANY = "Unknown Company"
DEFAULT_URL = "#"
DEFAULT_TEXT = "N/A"
DEFAULT_DESCRIPTION = "No description available."
PREVIEW_CHARS = 500
DATE_CHARS = 10
# ---------------------------------------------------------------------------


def rating_rows(shown: DataFrame, flag_col: str = "wants_to_rate", keys=("user_id", "job_hash"),
                order_cols=("ts", "event_id")) -> DataFrame:
    """Keep rated rows only (P16) and, per key, the latest rating (the
    keyed upsert of S8 applied within one batch)."""
    rated = shown.where(F.col(flag_col)).drop(flag_col)
    return latest_per_key(rated, list(keys), list(order_cols))


def preview_cards(postings: DataFrame) -> DataFrame:
    """Display fields with defaults for missing values and truncation."""
    posted = F.substring(F.col("posted_date").cast("string"), 1, DATE_CHARS)
    out = postings.withColumn(
        "card_title", F.concat(T.default("title", DEFAULT_TITLE), F.lit(" at "),
                               T.default("company", DEFAULT_COMPANY))
    ).withColumn("posted", T.default(posted, DEFAULT_TEXT)).withColumn(
        "preview", T.truncate(T.default("description", DEFAULT_DESCRIPTION), PREVIEW_CHARS, "..."))
    if "location" in postings.columns:
        out = out.withColumn("location", T.default("location", DEFAULT_TEXT))
    if "url" in postings.columns:
        out = out.withColumn("url", T.default("url", DEFAULT_URL))
    return out
