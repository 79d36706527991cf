"""Titles of instruments on planted names."""

from pyspark.sql import functions as F

from provenir.functions import titles as T

CASES = [
    ("Personal Data Protection Act 2012", "act"),
    ("Personal Data Protection Regulations (No. 3) 2021 revised edition", "regulation"),
    ("Guidelines on Data Breaches", "guideline"),
    ("The Draft Advisory Guidelines for Banks", "guideline"),
    ("Customs (Prohibition of Imports) Order 2017", "order"),
    ("Central Bank By-laws", "rule"),
    ("Circular No. 12", "notice"), ("Circular 12", None),
    ("Circulars", None),
    ("Understanding the Data Act", None),
    ("Minister launches the Data Act", None),
    ("Download the Data Act", None),
    ("Privacy notice of the site", None),
    ("The Data Act comes into force.", None),
    ("An act.", None),
    ("x" * 171 + " Act", None),
    ("Data Act, which every one of them knows well", None),
    ("Something (Banks' Code of Practice)", "guideline"), ("Something (Code of Practice)", None),
    ("Plan of the city", None),
    (None, None),
    ("", None),
]


def test_titles(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", T.title_kind(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(len(CASES))] == [k for _, k in CASES]
    df = spark.createDataFrame([("Data Protection Decree 7",), ("Decree on data",), ("Decreed things here",)], "t string")
    assert [r.k is not None for r in df.select(T.title_kind(F.col("t"), ["decree"]).alias("k")).collect()] == [False, True, False]


def test_kinds_and_what_is_about_the_law(spark):
    df = spark.createDataFrame([("act", None, "unknown", " "), ("act", "5", None, None), ("act", "", "in-force", None), ("act", None, None, "declared"), ("rule", None, None, None)], "k string, n string, s string, b string")
    assert [r.v for r in df.select(T.registered_kind(F.col("k"), F.col("n"), F.col("s"), F.col("b")).alias("v")).collect()] == ["publication", "act", "act", "act", "rule"]
    df = spark.createDataFrame([("Overview of this Part: duties",), ("Overview of the law of data",), ("An Act to provide",), (None,)], "t string")
    assert [r.v for r in df.select(T.opens_about(F.col("t")).alias("v")).collect()] == [False, True, False, False]
