"""Quality by ridge regression on random Fourier features.

A text becomes ``len(STATS)`` statistics (shares of character classes, lengths,
repetition), standardised by the labelled rows.  ``N_FEATURES`` random cosines
approximate a Gaussian kernel over them; ridge regression on the cosines is
solved from normal equations that every partition sums for itself (one upper
triangle per partition, added up by row in Spark), so all labelled rows that
are not held out train.  Isotonic calibration turns the raw score into the
share of label 1: rows of one fifth (remainder 1) stay out of the ridge and
are counted on a fixed grid of raw scores; pooling adjacent violators runs
over the grid, at most ``GRID`` rows.  Texts are read once: training and
scoring work on the narrow table of their statistics.

Defined cases: null and empty texts have all statistics zero; labels that are
null or unknown are ignored, of repeated labels of one id the larger counts;
without any label every score is 0.5; repeated rows score equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, broadcast_if_fits, held_out, table, write_shared

STATS = ("log_bytes", "log_words", "log_lines", "letter", "upper", "digit", "space", "punctuation", "symbol",
         "non_ascii", "word_length", "word_spread", "distinct_words", "top_word", "repeated_next", "distinct_lines",
         "symbol_words", "lone_words", "byte_entropy", "capital_words", "long_words", "line_words", "line_spread",
         "stops")
N_FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1e-3
SEED = 5
GRID = 400                     # raw scores from -0.5 to 1.5
CLIP = 6.0

_BYTE = np.arange(256)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT, _SPACE = (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_PUNCTUATION = np.isin(_BYTE, [ord(c) for c in ".,;:'\"!?()-"])
_ASCII = _BYTE < 128
_SYMBOL = _ASCII & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _PUNCTUATION)


def statistics(text: bytes | None) -> np.ndarray:
    """The ``STATS`` of one text."""
    out = np.zeros(len(STATS))
    words = text.split() if text else []
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, m = len(text), len(words)
    share = counts / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=m)
    lines = [line for line in text.split(b"\n") if line.strip()]
    line_words = np.array([line.count(b" ") + 1 for line in lines])
    ends = [w[-1] for w in words]
    seen = share[share > 0]
    out[:] = (
        np.log1p(n), np.log1p(m), np.log1p(len(lines)),
        (share[_UPPER].sum() + share[_LOWER].sum()), share[_UPPER].sum() / max(1e-9, (share[_UPPER].sum() + share[_LOWER].sum())),
        share[_DIGIT].sum(), share[_SPACE].sum(), share[_PUNCTUATION].sum(), share[_SYMBOL].sum(),
        share[~_ASCII].sum(), lengths.mean(), lengths.std(), len(number) / m,
        np.bincount(ids).max() / m, (ids[1:] == ids[:-1]).mean() if m > 1 else 0.0,
        len(set(lines)) / max(1, len(lines)),
        sum(_SYMBOL[e] or e == 33 for e in ends) / m, (lengths == 1).mean(), -(seen * np.log2(seen)).sum(),
        sum(_UPPER[w[0]] for w in words) / m, (lengths > 12).mean(),
        np.log1p(line_words.mean()), line_words.std() / line_words.mean(),
        sum(e == 46 for e in ends) / m)
    return out


class Kernel:
    """Random cosines of standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int = N_FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.frequency = rng.normal(0, 1 / BANDWIDTH, (len(mean), n))
        self.phase = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.frequency + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])


class Model:
    """Ridge scores on the kernel's features, calibrated by a step function."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, levels: np.ndarray):
        self.kernel, self.weights, self.levels = kernel, weights, levels

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        step = self.levels[grid_step(raw)]
        # a small share of the raw score keeps the order inside a step
        return np.clip(0.98 * step + 0.02 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def grid_step(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * GRID).astype(np.int64), 0, GRID - 1)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ``positive`` of ``n`` by pooling adjacent
    violators; empty grid steps take the value of the step below."""
    blocks: list[list[float]] = []                       # rows, positives, steps
    for i in range(len(n)):
        blocks.append([float(n[i]), float(positive[i]), 1])
        while len(blocks) > 1 and (blocks[-1][0] == 0 or
                                   blocks[-2][0] == 0 or
                                   blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.concatenate([np.full(int(k), p / m if m else 0.5) for m, p, k in blocks])


def _sums(df: DataFrame, cols: list[str], width: int, work) -> np.ndarray:
    """Sum over all partitions of the matrices ``work(lists of columns)``,
    added up row by row in Spark; only the total reaches the driver."""
    import pyarrow as pa

    def run(batches):
        total = None
        for batch in batches:
            part = work([batch.column(c).to_pylist() for c in cols])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                names=["row", "sums"])
    parts = df.mapInArrow(run, "row int, sums array<double>")
    added = parts.groupBy("row").agg(*[F.sum(F.get("sums", F.lit(j))).alias(f"c{j}") for j in range(width)]) \
        if width <= 4 else (parts.select("row", F.posexplode("sums").alias("place", "v"))
                                 .groupBy("row", "place").agg(F.sum("v").alias("v"))
                                 .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("vs")))
    rows = sorted(tuple(r) for r in added.collect())
    if width <= 4:
        return np.array([r[1:] for r in rows], dtype=float)
    return np.array([[v["v"] for v in r[1]] for r in rows], dtype=float)


def measure(docs: DataFrame, text_col: str = "text", stats_col: str = "_stats") -> DataFrame:
    """``docs`` plus the statistics of their texts."""
    return add_by_arrow(docs, [text_col], f"{stats_col} array<double>",
                        lambda cols: [[statistics(t) for t in cols[0]]])


def train(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          stats_col: str = "_stats") -> Model | None:
    """A model from measured documents and the labels of those not held out."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
                   .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label")))
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    rows = write_shared(
        measured.select(F.col(id_col).alias("_id"), F.col(stats_col).alias("_stats"))
                .join(broadcast_if_fits(known), "_id").select("_stats", "_label", fold.alias("_fold")), "quality-rows")
    moments = rows.select(F.posexplode("_stats").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).orderBy("i").collect()
    if not moments:
        return None
    kernel = Kernel(np.array([m["mean"] for m in moments]), np.array([m["spread"] for m in moments]))

    def normal(cols):
        z, y = kernel(np.array(cols[0])), np.array(cols[1])
        return np.hstack([z.T @ z, (z.T @ y)[:, None], np.full((z.shape[1], 1), float(len(y)))])
    fit = _sums(rows.filter("_fold <> 1"), ["_stats", "_label"], N_FEATURES + 3, normal)
    if not len(fit):
        fit = _sums(rows, ["_stats", "_label"], N_FEATURES + 3, normal)
    k = N_FEATURES + 1
    weights = np.linalg.solve(fit[:, :k] + RIDGE * fit[0, k + 1] / k * np.eye(k), fit[:, k])
    raw = Model(kernel, weights, np.zeros(GRID))

    def count(cols):
        step = grid_step(raw.raw(np.array(cols[0])))
        return np.stack([np.bincount(step, minlength=GRID),
                         np.bincount(step, np.array(cols[1]), minlength=GRID)], axis=1).astype(float)
    held = rows.filter("_fold = 1")
    seen = _sums(held if held.count() else rows, ["_stats", "_label"], 2, count)
    return Model(kernel, weights, isotonic(seen[:, 0], seen[:, 1]))


def score(measured: DataFrame, model: Model | None, stats_col: str = "_stats", score_col: str = "score") -> DataFrame:
    """``measured`` plus ``score_col`` between 0 and 1."""
    if model is None:
        return measured.withColumn(score_col, F.lit(0.5))
    shared = measured.sparkSession.sparkContext.broadcast(model)      # a fixed number of parameters

    def work(cols):
        # rounded, as sums in another order differ in the last digits
        return [np.round(shared.value.score(np.array(cols[0])), 9) if cols[0] else []]
    return add_by_arrow(measured, [stats_col], f"{score_col} double", work)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = write_shared(measure(docs).select("doc_id", "_stats"), "quality-stats")
    model = train(measured, table(spark, sf_dir, "labels"))
    return score(measured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
