import re

from pyspark.sql import functions as F

from matchbook.functions import text as T
from matchbook.operators.embedding import py_tokenize


def reference_tokens(text):
    # Behaviour being reproduced: whitelist, then lower, split, drop "", l, d.
    t = re.sub(r"[^a-zA-Z0-9\s#&œ+éèêàâç'’]", "", text).lower()
    return [x for x in re.split(r"['’\s]", t) if x not in ("", "l", "d")]


SAMPLES = [
    "L'Équipe DATA cherche d'un ingénieur C++ & C# à Paris!",
    "  Hello,\tWorld again now  ",
    "Être prêt: côté ÎLE, où ça? Ôté!",
    "l d ld dl l'd d'l",
    "",
    "rock’n’roll 100% +plus #tag",
]


def test_tokenize_matches_python_semantics(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, t string")
    got = {r.id: r.toks for r in df.select("id", T.tokenize("t").alias("toks")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == reference_tokens(s), s
        assert py_tokenize(s) == reference_tokens(s)


def test_capital_accents_vanish_not_fold(spark):
    df = spark.createDataFrame([("École Été",)], "t string")
    assert df.select(T.tokenize("t")).first()[0] == ["cole", "té"]


def test_strip_is_unicode_aware(spark):
    s = "   x y \n\x1c　"
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(T.strip("t")).first()[0] == s.strip()


def test_truncate_default_join(spark):
    df = spark.createDataFrame([("abcdef", None, ["a", "b"])], "s string, n string, arr array<string>")
    r = df.select(T.truncate("s", 3, "..."), T.default("n", "N/A"), T.join_list("arr", " or ")).first()
    assert tuple(r) == ("abc...", "N/A", "a or b")


def test_truncate_counts_code_points(spark):
    df = spark.createDataFrame([("éèêàâç",)], "s string")
    assert df.select(T.truncate("s", 4)).first()[0] == "éèêà"
