"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the first ``PREFIXES`` letters of longer words
(stems of compounds), hashed to ``2 ** BITS`` features that are on or off.  The
machine scores ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``: besides a weight per
term, every pair of terms interacts through ``RANK`` factors, so a term can
count differently beside another.  It is fitted by mini-batch AdaGrad on the
logistic loss over a bounded sample of labelled rows that are not held out
(``max_rows``, chosen by a seeded hash of the id); scoring covers every row.

Features stay out, with no effect, unless their chi-squared association with
the label over the sample reaches ``MIN_CHI``: the rest would only be learned by
heart.  Spark counts them; only the chosen features of the sample's rows reach
the driver, and their parameters are broadcast (at most ``2 ** BITS`` rows).

Defined cases: null and empty texts have no terms and score the intercept; rows
with a null label are no training rows; of repeated labels of one id the larger
counts; without both classes in the sample every score is the share of label 1
(0 when there is no label); repeated rows score equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, broadcast_if_fits, held_out, table, write_shared
from matchbook.llm.decontaminate import words_of

BITS = 18
PREFIXES = (4, 5, 6, 7)
RANK = 4
MIN_CHI = 15.0
MAX_ROWS = 20_000              # documented bound of the training sample
EPOCHS = 30
BATCH = 256
RATE = 0.1
DECAY = 2e-5
SEED = 11
CACHE = 200_000                # words a task remembers the features of
LOT = 1 << 20                  # features scored at once


def _feature(term: bytes) -> int:
    import zlib
    return (zlib.crc32(term) * 2654435761 & 0xFFFFFFFF) >> (32 - BITS)


def _word_features(word: bytes) -> tuple:
    letters = word.decode("utf-8", "ignore")
    stems = [(letters[:n] + "*").encode() for n in PREFIXES if n < len(letters)]
    return tuple(_feature(t) for t in (word, *stems))


def _collect(text: bytes | None, cache: dict, of_word) -> np.ndarray:
    """Sorted distinct values of ``of_word`` over the words of a text, which
    ``cache`` remembers from text to text."""
    out: set = set()
    if len(cache) > CACHE:
        cache.clear()
    for word in set(words_of(text)):
        got = cache.get(word)
        if got is None:
            got = cache[word] = of_word(word)
        if got:
            out.update(got)
    return np.array(sorted(out), dtype=np.int32)


def features(text: bytes | None, cache: dict) -> np.ndarray:
    """Sorted distinct features of a text."""
    return _collect(text, cache, _word_features)


class FactorizationMachine:
    """Logistic factorization machine over sparse 0/1 features."""

    def __init__(self, known: np.ndarray, rank: int = RANK, seed: int = SEED):
        self.known = known                                     # sorted feature numbers
        self.row = {int(f): i for i, f in enumerate(known)}
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weights = np.zeros(len(known))
        self.factors = rng.normal(0, 0.01, (len(known), rank))

    def places(self, feats: np.ndarray) -> np.ndarray:
        """Rows of the known ones among ``feats``."""
        if not len(self.known):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.known, feats)
        at[at == len(self.known)] = 0
        return at[self.known[at] == feats]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margins of texts given by the rows of their known features, as one
        sparse product (``LOT`` features at a time)."""
        out, at = [], 0
        while at < len(rows):
            to, held = at, 0
            while to < len(rows) and (to == at or held + len(rows[to]) <= LOT):
                held += len(rows[to])
                to += 1
            out.append(self._margins(rows[at:to]))
            at = to
        return np.concatenate(out) if out else np.zeros(0)

    def _margins(self, rows: list[np.ndarray]) -> np.ndarray:
        at = np.concatenate(rows).astype(np.int64)
        text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        f = self.factors[at]
        pairs = np.zeros(len(rows))
        for k in range(f.shape[1]):
            s = np.bincount(text, f[:, k], len(rows))
            pairs += s * s
        return (self.bias + np.bincount(text, self.weights[at], len(rows)) +
                0.5 * (pairs - np.bincount(text, (f * f).sum(axis=1), len(rows))))

    def margin(self, feats: np.ndarray) -> float:
        return float(self.margins([self.places(feats)])[0])

    def scores(self, texts: list, cache: dict) -> np.ndarray:
        """Scores of texts; ``cache`` remembers the known rows of words."""
        row = self.row

        def known_rows(word: bytes) -> tuple:
            return tuple(row[f] for f in _word_features(word) if f in row)
        margins = self.margins([_collect(t, cache, known_rows) for t in texts])
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        rows = [self.places(r) for r in rows]
        g_w, g_f, g_b = np.full(len(self.known), 1e-6), np.full(self.factors.shape, 1e-6), 1e-6
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                lens = np.array([len(rows[j]) for j in pick])
                at = np.concatenate([rows[j] for j in pick]) if lens.sum() else np.zeros(0, dtype=np.int64)
                row = np.repeat(np.arange(len(pick)), lens)
                f = self.factors[at]
                s = np.zeros((len(pick), f.shape[1]))
                np.add.at(s, row, f)
                margin = (self.bias + np.bincount(row, self.weights[at], len(pick)) +
                          0.5 * ((s * s).sum(1) - np.bincount(row, (f * f).sum(1), len(pick))))
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
                d_w = np.bincount(at, err[row], len(self.known))
                used = np.unique(at)
                d_f = np.zeros_like(self.factors)
                np.add.at(d_f, at, err[row][:, None] * (s[row] - f))
                d_w[used] += DECAY * self.weights[used]
                d_f[used] += DECAY * self.factors[used]
                g_w[used] += d_w[used] ** 2
                g_f[used] += d_f[used] ** 2
                self.weights[used] -= RATE * d_w[used] / np.sqrt(g_w[used])
                self.factors[used] -= RATE * 0.2 * d_f[used] / np.sqrt(g_f[used])
                g_b += err.sum() ** 2
                self.bias -= RATE * err.sum() / np.sqrt(g_b)


def associated(sample: DataFrame, least: float = MIN_CHI) -> np.ndarray:
    """Sorted features of ``sample`` (features, label) whose presence depends on
    the label (chi-squared with continuity correction).  Counted in Spark; only
    the chosen features reach the driver."""
    n, n1 = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    expected = F.col("have") * F.lit(n1 / n)
    spread = expected * F.lit(1 - n1 / n) * (1 - F.col("have") / n)
    counted = (sample.select(F.explode("features").alias("feature"), "label").groupBy("feature")
                     .agg(F.count(F.lit(1)).alias("have"), F.sum("label").alias("hit")))
    off = F.greatest(F.abs(F.col("hit") - expected) - 0.5, F.lit(0.0))
    chosen = counted.filter(off * off >= least * F.greatest(spread, F.lit(1e-9))).select("feature").collect()
    return np.array(sorted(r["feature"] for r in chosen), dtype=np.int32)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = MAX_ROWS):
    """A fitted machine, or the share of label 1 when a class is missing."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
                   .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")))
    total = known.count()
    keep = F.pmod(F.xxhash64(F.lit(SEED), F.col("_id").cast("string")), F.lit(1 << 20)) < \
        int((1 << 20) * min(1.0, max_rows / max(1, total)))
    known = known.filter(keep)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        broadcast_if_fits(known), "_id")

    def work(cols):
        cache: dict = {}
        return [[features(t, cache) for t in cols[0]]]
    sample = write_shared(add_by_arrow(texts, ["_text"], "features array<int>", work).select(
        F.col("_id").alias("id"), "features", F.col("_label").alias("label")), "toxicity-sample")
    share = sample.agg(F.avg("label")).first()[0]
    if not share or share == 1:
        return float(share or 0.0)
    machine = FactorizationMachine(associated(sample))
    shared = docs.sparkSession.sparkContext.broadcast(machine.known)       # at most 2 ** BITS numbers

    def keep(cols):
        known = shared.value
        return [[np.intersect1d(f, known, assume_unique=True).astype(np.int32) for f in cols[0]]]
    rows = sorted(tuple(r) for r in add_by_arrow(sample, ["features"], "chosen array<int>", keep).select(
        "id", "chosen", "label").collect())                  # at most about max_rows short rows
    machine.fit([np.array(r[1], dtype=np.int32) for r in rows], np.array([r[2] for r in rows], dtype=np.float64))
    return machine


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus ``score_col`` between 0 and 1."""
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)       # at most 2 ** BITS rows of parameters
    cache: dict = {}                                               # one in each task

    def work(cols):
        return [shared.value.scores(cols[0], cache)]
    return add_by_arrow(docs, [text_col], f"{score_col} double", work)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
