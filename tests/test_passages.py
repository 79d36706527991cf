"""Quotes and approximate substrings: places in the text, slips, scripts; against plain versions."""

import random

from pyspark.sql import functions as F

from provenir.functions import approximate as A
from provenir.functions import passages as P

SOURCE = "1. The “Minister” may — by order —\n require any   person to provide the data. A mayor may not."


def spans(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, quote string")
    got = {r.id: None if r.s is None else (r.s.start, r.s.end) for r in df.select("id", P.quote_span(F.col("text"), F.col("quote")).alias("s")).collect()}
    return [got[i] for i in range(len(rows))]


def test_exact_and_elided_quotes(spark):
    quotes = {
        'the "minister" may': "The “Minister” may",
        "the minister may": "The “Minister” may",
        "by\n order": "by order",
        "by orders": None,
        "The “Minister” may ... require any person … provide the data.": "The “Minister” may — by order —\n require any   person to provide the data.",
        "a MAYOR may not": "A mayor may not",
        "may ... order": None,
        "": None,
        "minister ... ayor ... require any person to provide": None,
        "*may* - by **order**": "may — by order",
    }
    got = spans(spark, [(SOURCE, q) for q in quotes])
    assert [None if s is None else SOURCE[s[0] : s[1]] for s in got] == list(quotes.values())


def test_places_behind_characters_of_two_units_and_of_two_lower_letters(spark):
    rows = [("😀 must keep its data", "must keep"), ("İİ must keep its data", "must keep"), ("𝒳 İ 😀😀: “Must\u00a0 keep”", "must keep"), ("must 😀 keep", "must 😀 keep"), (r"a.c \E x*(y) [z]", r"a.c \E x(y) [z]")]
    got = spans(spark, rows)
    assert [t[s[0] : s[1]] for (t, _), s in zip(rows[:2], got)] == ["must keep", "must keep"]
    assert got[2:] == [(9, 19), (0, 11), (0, 16)]


def test_lao_and_thai_blanks(spark):
    rows = [("ນ ໍ າ ເຂ້ ົ າ ຕາມ", "ນໍາເຂົ້າ"), ("ຂໍ້ມູນ ສ່ວນບຸກຄົນ", "ຂໍ້ມູນສ່ວນບຸກຄົນ"), ("ຄຳ ສັ່ງ", "ຄໍາສັ່ງ"), ("ซ ้าซ้อน กัน", "ซ้าซ้อน"), ("ไทย ดี", "ไทยดี")]
    got = spans(spark, rows)
    assert got[1] == (0, 17) and got[2] == (0, len("ຄຳ ສັ່ງ")) and got[3] == (0, len("ซ ้าซ้อน")) and got[4] is None


def plain_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_the_automaton_equals_the_edit_table():
    rnd = random.Random(3)
    for _ in range(1500):
        pattern = "".join(rnd.choice("abc😀") for _ in range(rnd.randint(1, rnd.choice([6, 90]))))
        text = "".join(rnd.choice("abc😀") for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.5:
            text += pattern[: len(pattern) // 2] + rnd.choice("abc") + pattern[len(pattern) // 2 + 1 :] + text
        least, end = plain_edits(pattern, text)
        for most in (0, 1, 2, 5):
            got = A.edits_within(pattern, text, most)
            if least > most:
                assert got is None
            elif len(pattern) > most:
                assert got == (least, end), (pattern, text, most)
                start, stop, edits = A.approximate_span(pattern, text, most)
                assert edits == least and stop == end and plain_edits(pattern, text[start:stop])[0] == least


def test_pieces_hold_the_pigeonhole():
    for n in range(1, 30):
        for k in range(6):
            own = A.pieces("x" * n, k)
            assert "".join(p for _, p in own) == "x" * n and [a for a, _ in own] == [sum(len(p) for _, p in own[:i]) for i in range(len(own))]


def test_acts_copied_with_slips(spark):
    quote = "ห้ามมิให้ผู้ใดประมวลผลข้อมูลเครดิตนอกราชอาณาจักร"
    rows = [
        ("ประมวลลข้อมูลเครดิต", quote, True),  # one character changed
        ("ประมวลผลข้อมูลเครดิตนอกราชอาณาณาจักร", quote, True),  # a syllable written twice
        ("ประมวลผล ... นอกราชอาณาจักร", quote, True),
        ("processing of credit data", quote, False),
        ("kept it", "shall keep its data", False),  # a short fragment has to be exact
        ("keep its", "shall keep its data", True),
        ("", quote, False),
        (None, quote, False),
        ("ab", "ab", False),
        ("shall retain the records for five years", "Shall retain “the records” for five years.", True),
    ]
    df = spark.createDataFrame([(i, a, q) for i, (a, q, _) in enumerate(rows)], "i int, a string, q string")
    got = {r.i: r.c for r in df.select("i", A.copied_from("a", "q").alias("c")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_near_quotes(spark):
    law = "1.2. хувийн мэдээллийг гадаад улсад дамжуулахыг хориглоно."
    cases = [
        (law, "хувийн мэдээлийг гадаад улсад дамжуулахыг", law[5:47]),
        (law, "хувийн нууцыг огт өөр газар хадгалахыг зөвшөөрнө", None),
        ("the quick brown fox jumps over the dog", "the quick brwn fox jumps over", None),
        ("İ😀 " + law.replace(" ", " \n   "), "хувийн мэдээлийг гадаад улсад дамжуулахыг", law[5:47].replace(" ", " \n   ")),
        (None, "хувийн мэдээлийг гадаад улсад дамжуулахыг", None),
        (law, None, None),
        ("дамжуулахыг " * 400 + law, "хувийн мэдээлийг гадаад улсад дамжуулахыг", law[5:47]),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q string")
    got = {r.i: r.s for r in df.select("i", A.near_span("t", "q").alias("s")).collect()}
    for i, (t, _, want) in enumerate(cases):
        span = got[i]
        found = None if span is None or span.start is None else t[span.start : span.end]
        assert found == want, i
    slips = "the quick brown fox jumps over the lazy dog"
    assert A.near("😀 A " + slips.upper() + " B", slips.replace("lazy", "lzy"), True) == (4, 4 + len(slips))


def test_near_quotes_prefer_the_passage_itself():
    passage = "the quick brown fox jumps over the lazy dog and runs away from the bear"
    slipped = passage[:14] + passage[15:39] + "#" + passage[40:]
    longer, shouted = passage.replace("lazy ", "lazy old "), passage.upper()
    for other in (longer, shouted):
        for text in (other + " " + passage, passage + " " + other, other + "\n" + "x" * 300 + passage):
            at = text.index(passage)
            assert A.near(text, slipped, True) == (at, at + len(passage)), text
    many = [passage.replace("fox", "cat")] * 12
    for gap in range(60):  # wherever the diagonals are cut into bands
        text = " ".join(many) + "x" * gap + passage + "".join(many)
        at = text.index(passage)
        assert A.near(text, slipped, True) == (at, at + len(passage)), gap


def test_nfc_marks_and_json(spark):
    df = spark.createDataFrame([(1, "café"), (2, None)], "id int, text string")
    assert {r.id: r.n for r in df.select("id", F.char_length(P.nfc("text")).alias("n")).collect()} == {1: 4, 2: None}
    df = spark.createDataFrame([(1, "น้ํา"), (2, "ซ ้าซ้อน"), (3, "ຄໍາ"), (4, "ไทย ดี")], "id int, text string")
    assert [r.t for r in df.select("id", P.marks_rejoined(P.am_folded(F.col("text"))).alias("t")).orderBy("id").collect()] == ["น้ำ", "ซ้าซ้อน", "ຄຳ", "ไทย ดี"]
    df = spark.createDataFrame([(1, 'Here it is: {"a": {"b": "}"}} and more }'), (2, '{not json} ```json\n{"x": 1}\n```'), (3, "no braces"), (4, None), (5, '{} {"y": 2}')], "id int, text string")
    assert [r.o for r in df.select("id", P.json_in("text").alias("o")).orderBy("id").collect()] == ['{"a": {"b": "}"}}', '{"x": 1}', None, None, "{}"]
