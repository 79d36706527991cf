"""Sums of money on planted wordings."""

import pytest
from pyspark.sql import functions as F

from provenir.functions import money as M

CASES = [
    ("a fine not exceeding $250", "AUS", (250.0, "AUD", True)),
    ("a fine not exceeding $250", None, None),
    ("US$1,000.50 in all", "AUS", (1000.5, "USD", False)),
    ("RM 5 000", "MYS", (5000.0, "MYR", False)),
    ("₹1,00,000 or more", "IND", (100000.0, "INR", False)),
    ("ปรับไม่เกิน ๕๐๐,๐๐๐ บาท", "THA", (500000.0, "THB", False)),
    ("five hundred ringgit", "MYS", (500.0, "MYR", False)),
    ("two hundred and fifty thousand Australian dollars", "SGP", (250000.0, "AUD", False)),
    ("one million two hundred thousand and ten rupees", "IND", (1200010.0, "INR", False)),
    ("hundred dollars", "AUS", (100.0, "AUD", True)),
    ("$250 or $300", "AUS", None),
    ("$250, that is $250.00", "AUS", (250.0, "AUD", True)),
    ("section 12 of the Act of 2010", "AUS", None),
    ("under section 12 an amount of 400", "AUS", (400.0, "AUD", True)),
    ("within 30 days, or 5 per cent", "AUS", None),
    ("the sum of 700 in Singapore dollars", "AUS", (700.0, "SGD", False)),
    ("IDR 5,000,000", None, (5000000.0, "IDR", False)),
    ("Rp5.000", "IDN", (5.0, "IDR", False)),
    ("form A12", "AUS", None),
    ("(3) of it", "AUS", None),
    ("100 yuan and 100 RMB", None, (100.0, "CNY", False)),
    ("100 baht and US$3", "THA", None),
    ("", "AUS", None),
    (None, "AUS", None),
    ("no number at all", "AUS", None),
    ("1,234,567 dollars", "SGP", (1234567.0, "SGD", True)),
]


@pytest.mark.parametrize("text,economy,want", CASES)
def test_sums(text, economy, want):
    assert M.stated(text, economy) == want


def test_number_words():
    for words, n in (("twenty-five", 25), ("nineteen hundred", 1900), ("three hundred and forty-two thousand one hundred", 342100), ("million", 1000000), ("two million", 2000000), ("one hundred thousand", 100000)):
        assert M.worded(words) == n


def test_columns(spark):
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(CASES)], "i int, t string, e string")
    got = {r.i: r.m for r in df.select("i", M.money(F.col("t"), F.col("e")).alias("m")).collect()}
    assert [None if got[i].amount is None else tuple(got[i]) for i in range(len(CASES))] == [c[2] for c in CASES]
    assert df.where("false").select(M.money(F.col("t")).alias("m")).count() == 0
