"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become whole numbers ``x = floor(64 c) + 1000000``.  The fit list holds
each distinct x vector once.  Its sums and its centred second moments are whole
numbers too: tasks centre at the whole part of the mean before they multiply,
add up in exact arithmetic and emit one small table each, which Spark sums by
cell; the fraction of the mean is taken off exactly at the end.  So the
covariance does not depend on how the rows are dealt.

The driver gets the covariance alone (dimension squared, at most ``MAX_DIM``
squared): Householder reflections make it tridiagonal, bisection on Sturm counts
finds the leading eigenvalues, inverse iteration their vectors, made orthogonal
within clusters of close eigenvalues.  The components are broadcast and every
row is projected where it lies.

Defined cases: rows whose vector is null or empty, or holds null or non-finite
entries, get no result; the same for rows whose length is not the one most
distinct vectors have (of equally frequent lengths the longer counts); ``64 c``
beyond 2**52 counts as 2**52 in its sign; a component whose eigenvalue is zero to
double precision (fewer distinct vectors than dimensions, or equal entries) has
a null ``whitened`` and takes no part in ``identity_error``, which is 0 when no
component is left; ``explained`` is 0 when the trace is; a ``deviation`` beyond a
long is null; repeated rows and rows of one id are projected each; equal vectors
get equal results; an empty table gives an empty one; columns named like an
output are replaced.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import bounded_batches, table, write_shared

SCALE, OFFSET = 64, 1_000_000      # of the contract's whole numbers
FAR = float(1 << 52)
TOP = 16
MAX_DIM = 4096
CLUSTER = 1e-3                     # eigenvalues closer than this share of the norm are made orthogonal
SEED = 5
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- eigenvectors

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and the Householder vectors (step, v) that turn a
    symmetric matrix into them."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    steps = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        size = np.abs(x[1:]).max()
        if size == 0:
            continue
        size = np.abs(x).max()
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        steps.append((k + 1, v))
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        x -= 2 * (v @ x) * v
        a[k + 1:, k] = a[k, k + 1:] = x
    return np.diag(a).copy(), np.diag(a, 1).copy(), steps


def counts_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``at`` (Sturm counts)."""
    tiny = np.finfo(float).tiny ** 0.5
    below = np.zeros(len(at), dtype=np.int64)
    q = np.ones(len(at))
    for i, d in enumerate(diag):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` largest eigenvalues, falling, by bisection."""
    d = len(diag)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    least, most = (diag - reach).min(), (diag + reach).max()
    slack = 4 * np.finfo(float).eps * max(abs(least), abs(most)) + np.finfo(float).tiny
    lo, hi = np.full(top, least - slack), np.full(top, most + slack)
    want = d - 1 - np.arange(top)                       # rank from below of each value
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        under = counts_below(diag, off, mid) <= want
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo + (hi - lo) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of at least ``floor``."""
    d = len(diag)
    main, up, up2, x = diag - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        low = off[i]
        if abs(low) > abs(main[i]):                     # exchange rows i and i + 1
            f = main[i] / low
            main[i], up[i], main[i + 1], up2[i], up[i + 1] = low, main[i + 1], up[i] - f * main[i + 1], up[i + 1], \
                -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if abs(main[i]) < floor:
                main[i] = floor
            f = low / main[i]
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for i in range(d - 1, -1, -1):
        rest = (up[i] * x[i + 1] if i + 1 < d else 0.0) + (up2[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] = (x[i] - rest) / main[i]
        size = np.abs(x[i:]).max()
        if size > 1e150:
            x /= size
    return x


def leading_components(cov: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of a symmetric matrix."""
    d = len(cov)
    top = min(top, d)
    most = np.abs(cov).max()
    scale = 2.0 ** np.frexp(most)[1] if most > 0 else 1.0             # a power of two: no rounding
    diag, off, steps = tridiagonal(cov / scale)
    values = leading_values(diag, off, top)
    norm = max(np.abs(diag).max() + (2 * np.abs(off).max() if d > 1 else 0.0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((top, d))
    first = 0                                           # where the cluster starts
    shift = values[0]
    for k in range(top):
        if k and values[k - 1] - values[k] > CLUSTER * norm:
            first = k
        # equal shifts would give equal solutions
        shift = min(values[k], shift - 4 * eps * norm) if k > first else values[k]
        x = rng.uniform(-1, 1, d)
        for _ in range(6):
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x), eps * norm)
            for _ in range(2):
                for other in vectors[first:k]:
                    x = x - (other @ x) * other
        vectors[k] = x / np.linalg.norm(x)
    for at, v in reversed(steps):                       # back to the matrix's own basis
        part = vectors[:, at:]
        part -= 2 * np.outer(part @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return np.maximum(values, 0.0) * scale, vectors


# ------------------------------------------------------------------ Spark work

def _whole(c):
    """Column: the vector as whole numbers."""
    def one(e):
        scaled = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), e.cast("double") * SCALE))
        return F.floor(scaled) + F.lit(OFFSET).cast("long")
    return F.transform(c, one)


def _usable(c):
    plain = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) &
                     (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & plain, F.lit(False))


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equally long rows without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _exact_gram(a: np.ndarray) -> np.ndarray:
    """a.T @ a of whole numbers, exact, as Python numbers."""
    most = float(np.abs(a).max()) if a.size else 0.0
    if most * most * len(a) < 2.0 ** 53:
        return (a.T.astype(np.float64) @ a.astype(np.float64)).astype(np.int64).astype(object)
    big = a.astype(object)
    return big.T @ big


def _summed_cells(df: DataFrame, kind: str, cells) -> dict:
    """Sums by cell of the small tables the tasks emit.  ``cells(matrices)``
    takes a task's matrices and returns {(i, j): value}."""
    import pyarrow as pa
    arrow = pa.float64() if kind == "double" else pa.decimal128(38, 0)
    cast = float if kind == "double" else Decimal
    bounded_batches(df.sparkSession)

    def run(batches):
        made = cells(_matrix(b.column(0)) for b in batches if b.num_rows)
        keys = list(made)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([cast(made[k]) for k in keys], arrow)], names=["i", "j", "v"])

    out = df.mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in out.collect()}       # at most (MAX_DIM + 1) squared cells


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Each distinct whole-number vector once (x), of the most frequent length."""
    x = vectors.filter(_usable(F.col(vec_col))).select(_whole(F.col(vec_col)).alias("x")).distinct()
    found = write_shared(x, "whitening-fit")
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return found
    if sizes["d"] > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} entries")
    return found.filter(F.size("x") == sizes["d"])


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and the sum of each dimension."""
    def cells(matrices):
        total, n = None, 0
        for a in matrices:
            part = a.astype(object).sum(axis=0) if np.abs(a).max() > (1 << 53) // len(a) else a.sum(axis=0)
            total = part.astype(object) + (0 if total is None else total)
            n += len(a)
        return {} if total is None else {(-1, 0): n, **{(i, 0): v for i, v in enumerate(total)}}
    got = _summed_cells(fit, "decimal(38,0)", cells)
    return int(got.get((-1, 0), 0)), [int(got[i, 0]) for i in range(len(got) - 1)]


def exact_covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, each entry rounded once."""
    at = [s // n for s in sums]
    centre = np.array(at, dtype=np.int64)

    def cells(matrices):
        total = 0
        for a in matrices:
            total = total + _exact_gram(a - centre)
        return {} if isinstance(total, int) else {(i, j): total[i, j] for i in range(len(total))
                                                  for j in range(i, len(total))}
    got = _summed_cells(fit, "decimal(38,0)", cells)
    rest = [s - n * c for s, c in zip(sums, at, strict=True)]         # n times the fraction of the mean
    cov = np.zeros((len(sums), len(sums)))
    for (i, j), v in got.items():
        cov[i, j] = cov[j, i] = (n * int(v) - rest[i] * rest[j]) / (n * n)
    return cov


class Whitening:
    """A fitted whitening: mean, components and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, top: int = TOP):
        self.n, self.sums = n, sums
        self.values, self.vectors = leading_components(cov, top)
        self.trace = float(np.trace(cov))
        zero = len(cov) * np.finfo(float).eps * max(float(np.abs(cov).sum(axis=1).max()), 0.0)
        self.live = self.values > zero
        self.explained = self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))
        self.identity_error = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python numbers."""
        most = max(int(np.abs(x).max()) if x.size else 0, 1)
        if most * self.n < 1 << 61:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, offsets: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        centred = (offsets / self.n).astype(np.float64)
        # row by row, so that equal rows give equal results in any batch
        scores = np.einsum("ij,kj->ik", centred, self.vectors)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, scores / np.sqrt(self.values), np.nan)


def deviations(offsets: np.ndarray) -> list:
    """Exact sums of squares; None beyond a long."""
    if offsets.dtype != object and float(np.abs(offsets).max(initial=0)) ** 2 * offsets.shape[1] < 2.0 ** 62:
        return (offsets * offsets).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (offsets.astype(object) ** 2).sum(axis=1).tolist()]


def fit(vectors: DataFrame, vec_col: str = "embedding", top: int = TOP) -> Whitening | None:
    """The whitening of a table's fit list, ``identity_error`` measured over it;
    None when no vector can be used."""
    rows = fit_list(vectors, vec_col)
    n, sums = exact_sums(rows)
    if not n:
        return None
    model = Whitening(n, sums, exact_covariance(rows, n, sums), top)
    live = int(model.live.sum())
    shared = rows.sparkSession.sparkContext.broadcast(model)           # one value per dimension and component

    def cells(matrices):
        total = 0
        for x in matrices:
            w = shared.value.project(shared.value.offsets(x))[:, shared.value.live]
            w = np.column_stack([w, np.ones(len(w))])
            total = total + w.T @ w
        return {} if isinstance(total, int) else {(i, j): total[i, j] for i in range(len(total))
                                                  for j in range(i, len(total))}
    got = _summed_cells(rows, "double", cells)
    worst = 0.0
    for i in range(live):
        for j in range(i, live):
            # the rows are centred already; what rounding left of their mean goes here
            value = got[i, j] / n - got[i, live] / n * (got[j, live] / n)
            worst = max(worst, abs(value - (i == j)))
    model.identity_error = worst
    return model


def whiten(vectors: DataFrame, model: Whitening | None, vec_col: str = "embedding") -> DataFrame:
    """Usable rows of ``vectors`` with a list ``whitening`` of (component, n,
    deviation, whitened, explained, identity_error)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = f"whitening array<struct<{', '.join(':'.join(c.split()) for c in OUT.split(', '))}>>"
    kept = [c for c in vectors.columns if c != "whitening"]
    schema = StructType(vectors.select(*kept).schema.fields + StructType.fromDDL(made).fields)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    kind = to_arrow_schema(StructType.fromDDL(made)).types[0]
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    bounded_batches(vectors.sparkSession)
    names = [*kept, "whitening"]
    x = "_" * (1 + max(map(len, kept))) + "x"                          # no column has this name
    usable = vectors.select(*kept, _whole(F.col(vec_col)).alias(x)).filter(
        _usable(F.col(vec_col)) & (F.size(vec_col) == len(model.sums)))

    def run(batches):
        m = shared.value
        k = len(m.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            off = m.offsets(_matrix(batch.column(x)))
            white, rows = m.project(off), batch.num_rows
            cells = pa.StructArray.from_arrays(
                [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, m.n, dtype=np.int64)),
                 pa.array([v for v in deviations(off) for _ in range(k)], pa.int64()),
                 pa.array(white.ravel(), from_pandas=True),
                 pa.array(np.tile(m.explained, rows)),
                 pa.array(np.full(rows * k, m.identity_error))],
                fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * k + 1, k, dtype=np.int32)), cells)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists.cast(kind)], names=names)

    return usable.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whiten(vectors, fit(vectors))
    return out.select("vec_id", F.inline("whitening"))
