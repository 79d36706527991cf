"""Charsets, headings, links, exceptions and running headers on literal cases; passages with slips against plain search."""

import random

from pyspark.sql import functions as F

from provenir.functions import passages as P
from provenir.operators import phrases as H
from provenir.sources import pages as S
from test_passages import plain_edits


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_charsets(spark):
    legacy = "закон".encode("windows-1251")
    rows = [
        (b"\xef\xbb\xbfx", "windows-1251", "text/html", "utf-8"),
        (b"\xff\xfea\x00", None, "text/html", "utf-16le"),
        (legacy, "Windows-1251", "text/html", "windows-1251"),
        ("закон".encode(), "windows-1251", "text/html", "utf-8"),
        (b"<meta charset='windows-1251'>" + legacy, None, "text/html", "windows-1251"),
        (b"<meta charset='windows-1251'>" + legacy, None, "text/plain", "utf-8"),
        (b'<?xml version="1.0" encoding="koi8-r"?>' + legacy, None, None, "koi8-r"),
        (None, None, None, "utf-8"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, body binary, header string, media string")
    assert values(df.select("id", P.charset(F.col("body"), F.col("header"), F.col("media")).alias("c")), "c") == [r[3] for r in rows]


def test_headings_and_links(spark):
    rows = [("Register Of Current Voluntary Codes", "in-force"), ("Past  decisions", "repealed"), ("Current and Repealed Codes", None), (None, None), ("Laws in\nforce, in-force rules", "in-force"), ("currently", None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, heading string")
    assert values(df.select("id", P.standing(F.col("heading")).alias("s")), "s") == [r[1] for r in rows]
    links = [("/legislation/acts", "Browse", True), ("/news/acts", "New Acts", False), ("/home", "Welcome", False), (None, "Codes of practice", True), ("/practice", "Practices", False)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(links)], "id int, path string, text string")
    assert values(df.select("id", P.worth_opening(F.col("path"), F.col("text")).alias("o")), "o") == [r[2] for r in links]


def test_who_may_govern_and_what_was_read(spark):
    df = spark.createDataFrame([(1, True, "act"), (2, False, "act"), (3, True, "publication"), (4, True, "rule"), (5, None, "act"), (6, True, None)], "id int, was_read boolean, kind string")
    assert values(P.may_govern(df), "id") == [1, 4]
    df = spark.createDataFrame([(1, None, 0), (2, "timeout", 0), (3, None, 2), (4, None, None)], "id int, failure string, unreadable int")
    assert values(P.read_in_full(df), "id") == [1, 4]


def test_exceptions(spark):
    rows = [
        ("Excludes government data", True, None, None, None, "government data"),
        ("Excludes government data", None, None, None, None, None),
        ("Telecoms are covered under Pillar 5", False, "Telecom operators", None, None, "asked in its own pillar"),
        ("Excludes small firms", False, "retail", True, "small firms", "within the stated exception"),
        ("Excludes small firms", False, "retail", True, "", None),
        (None, True, "telecom", True, "x", None),
        ("Telecoms are covered under Pillar 5", False, None, False, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "id int, exception string, government boolean, sector string, within boolean, target string")
    reason = P.excepted(F.col("exception"), F.col("government"), F.col("sector"), F.col("within"), F.col("target"), "(?i)telecom|e-?commerce|online market")
    assert values(df.select("id", reason.alias("r")), "r") == [r[5] for r in rows]


def test_running_headers(spark):
    rows = []
    for page in range(6):
        head = ["Personal Data Protection", "for the  utilities sector"] if page else []
        rows += [("a", page, i, x) for i, x in enumerate([f"page {page}", *head, f"Some words that only page number {'abcdef'[page]} holds", "........................"])]
    rows += [("b", page, 0, "A header that is repeated") for page in range(3)]
    rows += [("c", page, 0, f"A line for each page {'wxyz'[page] * 4}") for page in range(4)]
    got = S.running_headers(spark.createDataFrame(rows, "doc string, page int, i int, line string")).collect()
    assert [tuple(r) for r in got] == [("a", "Personal Data Protection for the utilities sector")]


def test_passages_with_slips_against_plain_search(spark):
    rnd = random.Random(7)
    words = lambda n, letters="abcde ": "".join(rnd.choice(letters) for _ in range(n))
    patterns = [(i, words(rnd.randint(9, 30))) for i in range(12)] + [(12, "ab"), (13, ""), (14, None), (15, "😀 wide 😀 pattern"), (15, "😀 wide 😀 pattern")]

    def damaged(p):
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(p))
            p = rnd.choice([p[:at] + p[at + 1 :], p[:at] + "#" + p[at + 1 :], p[:at] + "#" + p[at:]])
        return p

    docs = [(i, words(rnd.randint(0, 80)) + damaged(rnd.choice(patterns[:12])[1]) + words(20)) for i in range(60)] + [(90, None), (91, ""), (92, "x 😀 wide 😀 patern y"), (None, patterns[0][1])]
    got = {(r.doc_id, r.item_id): r for r in H.approximate_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(patterns, "item_id long, text string"), 2).collect()}
    want = {}
    for i, text in docs:
        for k, p in set(patterns):
            if p and len(p) > 2 and text:
                edits, end = plain_edits(p, text)
                if edits <= 2:
                    want[i, k] = (edits, end)
    assert {key: (r.edits, r.end) for key, r in got.items()} == want and len(want) > 20
    for (i, k), r in got.items():
        text, p = dict(docs)[i], dict(patterns)[k]
        assert plain_edits(p, text[r.start : r.end])[0] == r.edits
