from pyspark.sql import functions as F

from matchbook.functions.dims import education_label, experience_label, label_to_code, EDUCATION_LABELS
from matchbook.operators.profile import (array_weight_total, skill_share, standard_rules,
                                         validate_profiles)

PROFILES = [
    ("ok", [("Python", 50), ("SQL", 30), ("Cloud", 20)], [("a", 40), ("b", 20), ("c", 20), ("d", 20)], 2, 1),
    ("sum90", [("Python", 50), ("SQL", 40)], [("a", 40), ("b", 20), ("c", 20), ("d", 20)], 2, 1),
    ("empty", [], [("a", 100)], 2, 1),
    ("noedu", [("Python", 100)], [("a", 100)], None, 1),
    ("code9", [("Python", 100)], [("a", 100)], 9, 1),
]
SCHEMA = ("user_id string, tech array<struct<name:string,weight_pct:int>>, "
          "fam array<struct<category:string,weight_pct:int>>, education int, experience int")


def test_validation_rules(spark):
    df = spark.createDataFrame(PROFILES, SCHEMA)
    df = df.withColumn("tech_total", array_weight_total("tech")).withColumn(
        "fam_total", array_weight_total("fam"))
    rules = standard_rules(F.col("tech_total"), F.col("fam_total"),
                           required={"education": education_label("education"),
                                     "experience": experience_label("experience")})
    got = {r.user_id: (r.is_valid, r.violations) for r in validate_profiles(df, rules).collect()}
    assert got["ok"] == (True, [])
    assert got["sum90"] == (False, ["technical_total"])
    assert got["empty"] == (False, ["technical_total"])
    assert got["noedu"] == (False, ["missing_education"])
    assert got["code9"] == (False, ["missing_education"])    # unknown code has no label


def test_skill_share(spark):
    df = spark.createDataFrame([("u", "a", 50), ("u", "b", 30), ("u", "c", 20), ("z", "x", 0)],
                               "user_id string, skill string, w int")
    got = {(r.user_id, r.skill): r.share_pct for r in skill_share(df, "user_id", "w").collect()}
    assert got[("u", "a")] == 50.0 and got[("u", "c")] == 20.0
    assert got[("z", "x")] is None                            # zero total: NULL, no error


def test_code_label_roundtrip(spark):
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 9)], "c int")
    got = [tuple(r) for r in df.select("c", education_label("c").alias("l")).select(
        "c", "l", label_to_code("l", EDUCATION_LABELS).alias("back")).collect()]
    assert got[:4] == [(0, "None", 0), (1, "Bachelor", 1), (2, "Master", 2), (3, "PhD", 3)]
    assert got[4] == (9, None, None)


def test_empty_values_and_bounds_are_violations(spark):
    from matchbook.operators.profile import is_missing, out_of_bounds
    rows = [("a", [("x", 100)], ["t"]), ("", [("x", 101), ("y", -1)], []), ("  ", [("x", None)], None), (None, [], [""])]
    df = spark.createDataFrame(rows, "name string, tech array<struct<name:string,weight_pct:int>>, titles array<string>")
    got = df.select(is_missing(F.col("name")), is_missing(F.col("titles")), out_of_bounds("tech")).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, True), (True, True, True), (True, True, False)]
