"""Vectors: element-wise means, readiness, and the embedding-provider hook
(A1, A2, P17, X2)."""

from __future__ import annotations

import hashlib
import inspect
import re
import time
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.text import TOKEN_KEEP_CHARS, TOKEN_SPLIT_CHARS, TOKEN_STOP
from matchbook.sources.tables import spread_partitions

# --- fixed values -----------------------------------------------------------
FIELDS = ("description", "title")
REF_LANGS = ("FR", "EN")
DEFAULT_BATCH_SIZE = 50        # texts per inference call
MAX_KNOWN_TOKENS = 200_000     # digests an embedder remembers
# ---------------------------------------------------------------------------


def vector_dim(df: DataFrame, vec_col: str) -> int:
    """Largest vector length (one tiny aggregate job)."""
    return int(df.select(F.max(F.size(vec_col))).first()[0] or 0)


def elementwise_mean(df: DataFrame, group_cols, vec_col: str, dim: int | None = None,
                     out_col: str = "vec") -> DataFrame:
    """Element-wise mean of the vectors in each group, as ARRAY<DOUBLE>.

    One hash aggregate with ``dim`` numeric averages: partial averages are
    combined map-side, so a huge group costs one row per input partition in
    the shuffle.  Groups with vectors of differing lengths get NULL.
    """
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    dim = dim if dim is not None else vector_dim(df, vec_col)
    v = F.col(vec_col)
    aggs = [F.avg(F.get(v, i).cast("double")).alias(f"_m{i}") for i in range(dim)]
    aggs += [F.min(F.size(v)).alias("_lo"), F.max(F.size(v)).alias("_hi"),
             F.count(v).alias("n_vectors")]
    agg = df.where(v.isNotNull()).groupBy(*groups).agg(*aggs)
    same = (F.col("_lo") == dim) & (F.col("_hi") == dim)
    return agg.select(*groups,
                      F.when(same, F.array(*[F.col(f"_m{i}") for i in range(dim)])).alias(out_col),
                      "n_vectors")


def ref_readiness(refs: DataFrame, user_col: str = "user_id", fields=FIELDS,
                  langs=REF_LANGS) -> DataFrame:
    """Per user: is there a non-NULL reference vector for every (field, lang)?"""
    want = len(fields) * len(langs)
    ok = (F.col("vec").isNotNull() & F.col("field").isin(list(fields))
          & F.col("lang").isin(list(langs)))
    return (refs.groupBy(user_col)
                .agg(F.count_distinct(F.when(ok, F.struct("field", "lang"))).alias("n_ready"))
                .withColumn("ready", F.col("n_ready") == want))


def ready_references(refs: DataFrame, user_col: str = "user_id", fields=FIELDS,
                     langs=REF_LANGS) -> DataFrame:
    """Reference rows of users whose set is complete, in one pass.

    The per-user set of complete (field, lang) pairs has at most
    ``len(fields) * len(langs)`` entries, so a window ``collect_set`` over
    the user is bounded; the reference table is not re-aggregated.
    """
    return with_readiness(refs, user_col, fields, langs).where("ready").drop("ready")


def with_readiness(refs: DataFrame, user_col: str = "user_id", fields=FIELDS,
                   langs=REF_LANGS) -> DataFrame:
    """Reference rows plus the user's ``ready`` flag, in one pass."""
    want = len(fields) * len(langs)
    ok = (F.col("vec").isNotNull() & F.col("field").isin(list(fields))
          & F.col("lang").isin(list(langs)))
    w = Window.partitionBy(user_col)
    return refs.withColumn(
        "ready", F.size(F.collect_set(F.when(ok, F.struct("field", "lang"))).over(w)) == want)


# ---------------------------------------------------------------- X2 hook --

def py_tokenize(text: str | None) -> list[str]:
    """Python twin of :func:`matchbook.functions.text.tokenize` (for
    embedding providers that run inside Python workers)."""
    if text is None:
        return []
    kept = re.sub(f"[^{TOKEN_KEEP_CHARS}\\s]", "", text)
    parts = re.split(f"[{TOKEN_SPLIT_CHARS}\\s]", kept.lower())
    return [p for p in parts if p not in TOKEN_STOP]


class HashingEmbedder:
    """Deterministic offline embedding provider (feature hashing).

    Each token maps to one signed coordinate chosen by a stable digest; a
    text's sentence vector is the mean of its token vectors.  It needs no
    model files and no network, and is the default for tests and benches.
    Real providers follow the same call signature.

    Digest rule (MD5 of the UTF-8 token, as hex): the first 8 hex digits as
    an unsigned integer, modulo ``dim``, give the coordinate; the next two
    digits give the sign (odd: +1, even: -1).  MD5 is used because SQL
    engines have it too, so the stub's output can be checked independently.
    """

    def __init__(self, dim: int = 64, mode: str = "sentence"):
        if mode not in ("sentence", "token"):
            raise ValueError(f"invalid mode {mode!r}; must be 'token' or 'sentence'")
        self.dim, self.mode = dim, mode
        self._known: dict[str, tuple[int, float]] = {}

    def _place(self, tok: str) -> tuple[int, float]:
        """Coordinate and sign of a token, digested once while remembered."""
        got = self._known.get(tok)
        if got is None:
            if len(self._known) >= MAX_KNOWN_TOKENS:
                self._known.clear()
            h = hashlib.md5(tok.encode("utf-8")).hexdigest()
            got = self._known[tok] = int(h[:8], 16) % self.dim, (1.0 if int(h[8:10], 16) & 1 else -1.0)
        return got

    def __call__(self, texts: list[str]):
        out = []
        for t in texts:
            places = [self._place(x) for x in py_tokenize(t)]
            idx = np.array([p for p, _ in places], dtype=np.int64)
            sign = np.array([s for _, s in places])
            if self.mode == "token":
                vecs = np.zeros((len(places), self.dim), dtype=np.float32)
                vecs[np.arange(len(places)), idx] = sign
                out.append(list(vecs))
            else:
                total = np.bincount(idx, weights=sign, minlength=self.dim) if places else np.zeros(self.dim)
                out.append((total / max(1, len(places))).astype(np.float32))
        return out


def made(provider):
    """The provider itself, or what a factory without arguments makes."""
    try:
        bare = not inspect.signature(provider).parameters
    except (TypeError, ValueError):
        bare = False
    return provider() if bare else provider


class Calls:
    """``model`` in calls of at most ``batch_size`` items, with a pause between any
    two calls of a task, whichever Arrow batch they belong to."""

    def __init__(self, model: Callable, batch_size: int, pause_seconds: float = 0.0):
        self.model, self.batch_size, self.pause_seconds = model, batch_size, pause_seconds
        self.called = False

    def __call__(self, items: list) -> list:
        out = []
        for i in range(0, len(items), self.batch_size):
            if self.called and self.pause_seconds:
                time.sleep(self.pause_seconds)
            self.called = True
            out.extend(self.model(items[i:i + self.batch_size]))
        return out


def in_calls(model: Callable, items: list, batch_size: int, pause_seconds: float = 0.0) -> list:
    """``model`` over ``items`` in calls of at most ``batch_size``, with a pause
    between two calls."""
    return Calls(model, batch_size, pause_seconds)(items)


def embed_texts(df: DataFrame, key_cols, text_col: str,
                provider: Callable | None = None, dim: int = 64, batch_size: int = DEFAULT_BATCH_SIZE,
                pause_seconds: float = 0.0, partitions: int | None = None, token_mode: bool | None = None) -> DataFrame:
    """Run an embedding provider over ``text_col`` in Arrow batches.

    ``provider`` is a provider, or a factory without arguments that makes one
    (then it is built inside each task, not on the driver).  It is called with
    at most ``batch_size`` texts at a time, ``pause_seconds`` apart (T5).
    ``partitions`` spreads the input first.  Output:
    ``key_cols + vec ARRAY<FLOAT>`` (sentence mode) or
    ``key_cols + pos INT + vec`` (token mode).
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    provider = provider or HashingEmbedder(dim)
    if token_mode is None:
        token_mode = getattr(provider, "mode", "sentence") == "token"
    sel = spread_partitions(df.select(*keys, text_col), partitions)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in sel.schema.fields if f.name in keys)
    schema = key_schema + (", pos int" if token_mode else "") + ", vec array<float>"

    def run(batches):
        model = Calls(made(provider), batch_size, pause_seconds)
        for pdf in batches:
            vecs = model(pdf[text_col].tolist())
            if token_mode:
                rows = [(*k, p, np.asarray(v, np.float32))
                        for k, tv in zip(pdf[keys].itertuples(index=False), vecs)
                        for p, v in enumerate(tv)]
                yield pd.DataFrame(rows, columns=keys + ["pos", "vec"])
            else:
                out = pdf[keys].copy()
                out["vec"] = [np.asarray(v, np.float32) for v in vecs]
                yield out

    return sel.mapInPandas(run, schema)
