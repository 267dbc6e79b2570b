"""Text functions: strip, case, truncation, defaults, list joins, tokens.

Every function returns a Column built from Spark built-ins, so it stays in the
JVM; those that take a lambda over an array (and the tokenizer's stop-word
filter) are interpreted, the others join whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's notion of whitespace (str.isspace / re's \s on str patterns),
# spelled out so that the JVM regex matches exactly the same characters.
PY_WHITESPACE_JAVA = (r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\u1680"
                      r"\u2000-\u200A\u2028\u2029\u202F\u205F\u3000")
# Same class in RE2 syntax (used by the DuckDB oracle).
PY_WHITESPACE_RE2 = (r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\x{1680}"
                     r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Characters the tokenizer keeps (besides whitespace); everything else is
# deleted *before* lower-casing, so capital accented letters vanish.
TOKEN_KEEP_CHARS = "a-zA-Z0-9#&œ+éèêàâç'’"
# Token separators besides whitespace.
TOKEN_SPLIT_CHARS = "'’"
# Tokens dropped after splitting (empty string and the elided articles).
TOKEN_STOP = ("", "l", "d")
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python-style ``str.strip()``: remove leading/trailing Unicode space."""
    ws = PY_WHITESPACE_JAVA
    return F.regexp_replace(_c(x), f"^[{ws}]+|[{ws}]+$", "")


def strip_lower(x) -> Column:
    return F.lower(strip(x))


def truncate(x, n: int, suffix: str | None = None) -> Column:
    """First ``n`` code points, optionally followed by ``suffix``."""
    out = F.substring(_c(x), 1, n)
    return F.concat(out, F.lit(suffix)) if suffix else out


def default(x, value: str) -> Column:
    """Value, or ``value`` when missing (NULL)."""
    return F.coalesce(_c(x), F.lit(value))


def join_list(arr, sep: str = ", ") -> Column:
    return F.array_join(_c(arr), sep)


def tokenize(x) -> Column:
    """Whitelist characters, lower-case, split on apostrophes/whitespace.

    Returns ARRAY<STRING> without empty tokens and without ``l``/``d``.
    """
    ws = PY_WHITESPACE_JAVA
    # "(?s)(?![keep])." deletes exactly what "[^keep]" would, but the JVM
    # regex engine runs the negated range union several times slower.
    kept = F.regexp_replace(_c(x), f"(?s)(?![{TOKEN_KEEP_CHARS}{ws}]).", "")
    parts = F.split(F.lower(kept), f"[{TOKEN_SPLIT_CHARS}{ws}]")
    stop = [F.lit(s) for s in TOKEN_STOP]
    return F.filter(parts, lambda t: ~t.isin(*stop))


def tokenize_sql_duckdb(expr: str) -> str:
    """The same tokenizer as a DuckDB SQL expression (for oracles)."""
    ws = PY_WHITESPACE_RE2
    keep = TOKEN_KEEP_CHARS.replace("'", "''")
    split = TOKEN_SPLIT_CHARS.replace("'", "''")
    kept = f"regexp_replace({expr}, '[^{keep}{ws}]', '', 'g')"
    parts = f"string_split_regex(lower({kept}), '[{split}{ws}]')"
    return f"list_filter({parts}, lambda t: t NOT IN ('', 'l', 'd'))"


def strip_sql_duckdb(expr: str) -> str:
    ws = PY_WHITESPACE_RE2
    return f"regexp_replace({expr}, '^[{ws}]+|[{ws}]+$', '', 'g')"
