"""Small fixtures shared by the llm tests."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (id, text[, source]) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df, *names):
    """``df`` with extra columns of the given names."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit("extra"))
    return df


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k=5):
    words = WORD.findall(fold(text or ""))
    w = min(k, len(words))
    return {tuple(words[i:i + w]) for i in range(len(words) - w + 1)} if words else set()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n, vocabulary=4000):
    import random
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
