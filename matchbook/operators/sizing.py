"""Checked broadcast decisions.

A side is broadcast only after a probe proves it has at most ``max_rows``
rows.  The probe is an exact count: each task counts its own partition and
one partial count per partition crosses the shuffle.  (``limit(n).count()``
looks cheaper but plans as a local limit, an exchange into a single
partition and a global limit, so on a large input whose partitions each
hold fewer than ``n`` rows every row is funnelled into one task.)  Every
side is also bounded in bytes: a row count alone says nothing when rows hold
texts or arrays of unknown length.  Callers supply the other plan for the
large case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
# Budget for a broadcast side holding vectors (each executor keeps a copy,
# and a Python-side broadcast one per Python worker).
DEFAULT_MAX_BROADCAST_BYTES = 128 << 20
ELEMENT_BYTES = 8                       # vectors are widened to DOUBLE
ROW_OVERHEAD_BYTES = 64                 # keys and array headers, per row


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    return df.count() <= max_rows


def row_bytes(df: DataFrame):
    """A column: the bytes a row's values hold, roughly (texts and binaries by
    their length, arrays and maps by their entries written as text, 8 bytes
    for anything else)."""
    size = F.lit(ROW_OVERHEAD_BYTES).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
        else:
            size = size + ELEMENT_BYTES
    return size


def total_bytes(df: DataFrame) -> int:
    """The bytes that all rows hold, by :func:`row_bytes`; arrays of numbers by their lengths."""
    flat = [name for name, kind in df.dtypes if kind in ("array<double>", "array<float>", "array<bigint>", "array<int>")]
    size = row_bytes(df.drop(*flat))
    for name in flat:
        size = size + F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)) * ELEMENT_BYTES
    return df.agg(F.sum(size)).first()[0] or 0


def is_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
             max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes
    (one aggregate, combined map-side)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES):
    """Return ``(df_or_broadcast_df, was_broadcast)``; small in rows and bytes."""
    if is_small(df, max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False


def fits_in_bytes(df: DataFrame, array_cols, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                  max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> bool:
    """Probe: at most ``max_rows`` rows whose ``array_cols`` hold at most
    ``max_bytes`` in all (``ELEMENT_BYTES`` per element plus a fixed
    per-row overhead).  One aggregate job, combined map-side."""
    cols = [array_cols] if isinstance(array_cols, str) else list(array_cols)
    elems = sum((F.coalesce(F.size(c), F.lit(0)) for c in cols), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(elems.cast("long")).alias("e")).first()
    n, e = int(r["n"]), int(r["e"] or 0)
    return n <= max_rows and n * ROW_OVERHEAD_BYTES + e * ELEMENT_BYTES <= max_bytes
