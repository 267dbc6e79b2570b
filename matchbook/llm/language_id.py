"""Language identification in two steps: the family, then the language in it.

A text's features are its lower-cased letters in runs: single letters, pairs,
triples and quadruples of letters (word ends included), hashed to ``2 ** BITS``
counts; the logarithms of the counts, scaled to length 1, are the vector.  Linear
support vector machines (squared hinge, dual coordinate descent), one for every
two classes, separate first the families and then, inside the family that won,
its languages: a class gets a vote of every machine it wins, and of equal votes
the larger sum of margins counts.  So closely related languages are only told
apart by machines that saw nothing else.

``FAMILIES`` groups codes; a code it does not name is a family of its own, so
any value of ``lang`` can be learned.  The machines are fitted on a bounded
sample of the labelled rows that are not held out: about ``MAX_ROWS`` and at
most twice as many, shared out evenly over the languages and chosen by a seeded
hash of id and text.  Every row is scored where it lies, whole texts, with broadcast weights.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
is every text when nothing could be learned; with one learned language every
other text gets it, with score 1; rows with a null lang or a text without a
letter are no training rows; ties go to the language that sorts first; repeated
rows score equal; very long texts are counted in pieces of ``PIECE`` letters; an
empty table gives an empty one; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import add_by_arrow, held_out, table

# Families of language codes (ISO 639-1).
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "bs", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "baltic": ("lt", "lv"),
}
BITS = 14
MAX_ROWS = 5000                # documented bound of the training sample
MAX_LANGUAGES = 400            # machines grow with the square of a family
COST = 4.0
EPOCHS = 12
SEED = 12
PIECE = 1 << 20
SHARPNESS = 4.0                # of a margin, as a probability
STEPS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def family_of(lang: str) -> str:
    """The family of a code, or the code itself."""
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


_KIND = np.full(0x110000, -1, dtype=np.int8)               # 1 a letter, 0 none, -1 not yet asked


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    new = np.unique(codes[_KIND[codes] < 0])
    _KIND[new] = [chr(k).isalpha() for k in new.tolist()]
    codes = np.concatenate([np.zeros(1, "<u4"), np.where(_KIND[codes] == 1, codes, 0), np.zeros(1, "<u4")])
    gap = codes == 0
    return codes[~(gap & np.concatenate([[False], gap[:-1]]))]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed features; None when there is no letter."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    any_letter = False
    for start in range(0, len(text or ""), PIECE):
        codes = letters(text[start:start + PIECE])
        if len(codes) < 3 and not codes.any():
            continue
        any_letter = True
        h = np.zeros(len(codes), dtype=np.uint32)
        inner = np.ones(len(codes), dtype=bool)                # no gap but at the ends
        for n, step in enumerate(STEPS):
            h = h[:len(codes) - n] * np.uint32(31) + codes[n:].astype(np.uint32) if n else codes.astype(np.uint32)
            if not len(h):
                break
            if n >= 2:
                inner = inner[:len(h)] & (codes[n - 1:len(codes) - 1] != 0)
            use = inner[:len(h)] & (h != 0)
            out += np.bincount((h[use] * np.uint32(step)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out if any_letter else None


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and their weights, of length 1."""
    found = counts(text)
    if found is None:
        return None
    at = np.flatnonzero(found)
    weight = np.log1p(found[at]).astype(np.float32)
    return at.astype(np.int32), weight / np.float32(np.linalg.norm(weight))


def linear_svm(rows: list, signs: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights (the last one is the bias) of a squared-hinge machine; both signs
    weigh alike in sum."""
    weights = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    share = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (-1, 1)}
    slack = np.array([1 / (2 * cost * share[int(s)]) for s in signs])
    rng = np.random.default_rng(SEED)
    rows = [(np.append(at, 1 << BITS), np.append(w, 1.0)) for at, w in rows]
    squares = np.array([w @ w for _, w in rows]) + slack
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, w = rows[i]
            gradient = signs[i] * (weights[at] @ w) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - gradient / squares[i], 0.0)
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * signs[i] * w
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


class PairwiseMachines:
    """One machine for every two of some classes."""

    def __init__(self, rows: list, classes: list[str]):
        self.names = sorted(set(classes))
        self.pairs = [(a, b) for a in range(len(self.names)) for b in range(a + 1, len(self.names))]
        number = np.array([self.names.index(c) for c in classes])
        weights = []
        for a, b in self.pairs:
            mine = np.flatnonzero((number == a) | (number == b))
            weights.append(linear_svm([rows[i] for i in mine], np.where(number[mine] == a, 1, -1)))
        self.weights = np.array(weights, dtype=np.float32).reshape(len(self.pairs), (1 << BITS) + 1)

    def decide(self, at: np.ndarray, w: np.ndarray) -> tuple[str, float]:
        """The class with most votes and the probability of its closest duel."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, at].astype(np.float64) @ w + self.weights[:, -1]
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.names)), key=lambda c: (votes[c], sums[c], -c))
        least = min(m if a == best else -m for (a, b), m in zip(self.pairs, margins.tolist(), strict=True)
                    if best in (a, b))
        return self.names[best], float(1 / (1 + np.exp(-np.clip(SHARPNESS * least, -30, 30))))


class Hierarchy:
    """Machines between families, and within each family between its languages."""

    def __init__(self, rows: list, langs: list[str]):
        families = [family_of(c) for c in langs]
        self.families = PairwiseMachines(rows, families)
        self.within = {}
        for f in self.families.names:
            mine = [i for i, g in enumerate(families) if g == f]
            self.within[f] = PairwiseMachines([rows[i] for i in mine], [langs[i] for i in mine])

    def decide(self, text: str | None) -> tuple[str, float]:
        found = vector(text)
        if found is None:
            return "und", 0.0
        family, sure = self.families.decide(*found)
        lang, inside = self.within[family].decide(*found)
        return lang, sure * inside


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          max_rows: int = MAX_ROWS) -> Hierarchy | None:
    """The machines of a bounded sample, or None without a training row."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col)).alias("order"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
             .limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return None
    each = max(1, max_rows // len(sizes))
    # share of the hash range that leaves about `each` rows of a language
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, each / n))])
    part = (F.shiftright(F.col("order"), 32).cast("double") / float(1 << 32)) + 0.5
    picked = known.filter(part < share[F.col("lang")])

    def work(cols):
        made = [vector(t.decode("utf-8", "replace")) for t in cols[0]]
        return [[None if v is None else v[0].astype(np.uint16).tobytes() for v in made], [None if v is None else v[1].tobytes() for v in made]]
    # copies of a text count once, so that they cannot fill the sample
    sample = (add_by_arrow(picked, ["text"], "places binary, weights binary", work).drop("text")
              .filter("places is not null").dropDuplicates(["lang", "order"]).orderBy("order", "lang").limit(2 * max_rows))
    rows = sorted((r["order"], r["lang"], bytes(r["places"]), bytes(r["weights"])) for r in sample.collect())
    if not rows:
        return None
    return Hierarchy([(np.frombuffer(p, np.uint16).astype(np.int32), np.frombuffer(w, np.float32)) for _, _, p, w in rows],
                     [lang for _, lang, _, _ in rows])


def identify(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and a score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)       # 64 KB a machine

    def work(cols):
        m = shared.value
        out = [m.decide(None if t is None else t.decode("utf-8", "replace")) if m else ("und", 0.0) for t in cols[0]]
        return [[p for p, _ in out], [s for _, s in out]]
    return add_by_arrow(docs, [text_col], f"{pred_col} string, {score_col} double", work)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
