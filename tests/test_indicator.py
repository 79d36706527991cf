"""Suppression and retrieval for an indicator on planted cases."""

import random
import re

from pyspark.sql import functions as F

from provenir.operators import indicator as I
from provenir.operators import suppression as S


def ids(df, name="doc_id"):
    return sorted(r[name] for r in df.collect())


def counterparts(rows):
    """The rule of copies in another language, one section after the other."""
    out, groups = [], {}
    for i, owner, label, lang, text, path in rows:
        if i is not None and label is not None and lang is not None:
            groups.setdefault((owner, label), []).append((i, lang, text or "", path or ""))

    def cited(text, label):
        return {f.upper() for f in re.findall(r"\d+(?:\.\d+)*[A-Z]{0,2}\b", text, re.A)} - {label.upper()}

    def filed(path):
        return set(re.findall(r"\b(?:\d+[A-Z]?|[IVXLC]+)\b", " > ".join(path.split(" > ")[:-1]), re.A))

    for (_, label), own in groups.items():
        free = [r for r in sorted(own) if r[1] == "en"]
        for i, lang, text, path in sorted(own):
            if lang == "en":
                continue
            mine, where, scored = cited(text, label), filed(path), []
            for c, _, other, other_path in free:
                theirs, there = cited(other, label), filed(other_path)
                if where and there and not where & there or not 0.5 <= len(text) / max(1, len(other)) <= 2.2:
                    continue
                if not mine and not theirs:
                    scored += [(0, c)] if len(free) == 1 else []
                elif mine and theirs and len(mine & theirs) / len(mine | theirs) >= 0.5:
                    scored.append((len(mine & theirs) / len(mine | theirs), c))
            scored.sort(reverse=True)
            if scored and not (len(scored) > 1 and scored[0][0] == scored[1][0]):
                out.append((i, scored[0][1]))
                free = [r for r in free if r[0] != scored[0][1]]
    return sorted(out)


def test_copies_in_another_language_one_after_the_other(spark):
    rnd, rows = random.Random(4), []
    for i in range(500):
        text = " ".join(rnd.choice(["12A", "709", "4.2", "12", "word", "Wort", "2010", "3"]) for _ in range(rnd.randint(0, 7)))
        path = rnd.choice([None, "Part I > 3 Duties", "Schedule 2 > 1 Fees", "Teil I > 3", "plain"])
        rows.append((i, rnd.choice("ab"), rnd.choice(["3", "12", "4.2", "7"]), rnd.choice(["en", "th", "fr"]), text, path))
    rows += [(900, "z", "1", "th", "same 5", None), (901, "z", "1", "en", "same 5", None), (902, "z", "1", "en", "same 5", None), (903, "y", None, "th", "x", None), (None, "y", "1", "th", "x", None), (905, "y", "1", None, "x", None), (906, "y", "9", "th", None, None), (907, "y", "9", "en", "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, label string, lang string, text string, path string, id int")
    got = sorted(map(tuple, S.other_language_copies(df, path="path").collect()))
    assert got == counterparts(rows) and len(got) > 10
    assert S.other_language_copies(df.where("false")).count() == 0


def test_headings_that_summarise_and_titles_of_decided_cases(spark):
    rows = [(1, "Simplified outline of this Part"), (2, "Guide to this Division"), (3, "Outline of powers"), (4, None), (5, "Notice of initiation of an  investigation in respect of imports of paper"), (6, "Notice of initiation"), (7, "Customs (Investigation) Act in respect of goods")]
    df = spark.createDataFrame(rows, "doc_id long, heading string")
    assert ids(S.outlines(df)) == [1, 2] and ids(S.decided_cases(df)) == [5]


def test_second_registrations_and_repeated_provisions(spark):
    rows = [(1, "a", "x", False), (2, "a", "x", True), (3, "a", "x", True), (4, "b", "x", False), (5, "b", "y", False), (6, "b", "y", False), (7, "c", "z", True), (8, "d", "z", False), (9, "e", None, False), (10, "e", None, False)]
    df = spark.createDataFrame(rows, "doc_id long, source string, digest string, stands boolean")
    assert ids(S.second_registrations(df)) == [1, 3, 6]
    nothing = df.select("doc_id").where("false")
    assert ids(S.repeated_provisions(df, nothing)) == [1, 4, 8]
    # where the identified copy is taken already, the bare one is the only place to read the words
    assert ids(S.repeated_provisions(df, df.where("doc_id = 7").select("doc_id"))) == [1, 4]
    assert ids(S.repeated_provisions(df, df.where("doc_id in (2, 3, 7)").select("doc_id"))) == []


def test_a_cascade_keeps_the_first_cause_and_all_of_them(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    causes = [("one", lambda _: df.where("doc_id < 2")), ("two", lambda _: df.where("doc_id in (1, 3)")), ("rest", lambda taken: df.where("doc_id < 5").join(taken, "doc_id", "left_anti"))]
    got = {r.doc_id: (r.reason, r.reasons) for r in S.cascade(causes, df.where("false")).collect()}
    assert got == {0: ("one", ["one"]), 1: ("one", ["one", "two"]), 3: ("two", ["two"]), 2: ("rest", ["rest"]), 4: ("rest", ["rest"])}


def ranked(spark, *names):
    return spark.createDataFrame([(n, k + 1, "lexical", "depth") for k, n in enumerate(names)], "doc_id long, rank int, channels string, seat string")


def test_the_first_list_is_untouched(spark):
    got = S.appended(ranked(spark, 5, 3, 9), ranked(spark, 3, 7, 5, 1)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [5, 3, 9, 7, 1] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_what_is_left_to_be_prescribed_is_followed(spark):
    duty = "Goods whose customs value does not exceed 68(1)(f) or such other amount as is prescribed need no entry of import goods"
    rows = [
        (1, "act", duty),
        (2, "act", "For 68(1)(f) of the Act the sum is $1 000"),
        (3, "act", "The customs value of goods without entry is five hundred ringgit of import"),
        (4, "act", "Customs value goods import entry: RM 20 exceed need"),
        (5, "act", "Customs value of goods exceed $5 or such other amount as is prescribed"),
        (6, "other", "Customs value of goods import entry exceed need $900"),
        (7, "act", "A dog licence is $7"),
        (8, "act", "the prescribed amount of customs value on goods of import"),
        (9, "act", None),
    ]
    sections = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = ranked(spark, 1, 7, 8)
    got = sorted(map(tuple, I.prescribed(found, sections).collect()))
    assert {(t, behind) for t, behind, _ in got} == {(2, 1), (4, 1), (3, 3)}
    assert (2, 1, 0) in got  # it cites the clause
    order = I.answered(found, found.where("false"), I.prescribed(found, sections)).orderBy("rank").collect()
    assert [r.doc_id for r in order] == [1, 2, 4, 7, 8, 3] and [r["rank"] for r in order] == list(range(1, 7))


def test_codes_bring_one_section_of_each_owner(spark):
    sections = spark.createDataFrame([(1, "a", "duty 854231"), (2, "a", "duty 854232"), (3, "b", "duty 854231"), (4, "c", "no code"), (5, "d", "duty 854231"), (6, "e", "duty 854231")], "doc_id long, source string, text string")
    lexical = spark.createDataFrame([(0, 2, 5), (1, 2, 1), (0, 1, 2), (0, 3, 4), (0, 4, 1), (0, 5, 3), (1, 6, 9)], "run_no int, doc_id long, rank int")
    got = I.coded(lexical, sections, ranked(spark, 5), sections.where("doc_id = 6"), "duty", "[0-9]{6}")
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 2)]


def test_seats_shares_and_governing_owners(spark):
    runs = spark.createDataFrame([(0, "lexical", i, i) for i in range(1, 81)] + [(1, "dense", 100 - i, i) for i in range(1, 41)], "run_no int, channel string, doc_id long, rank int")
    owners = spark.createDataFrame([(i, "big" if i <= 60 else f"own{i // 10}") for i in range(1, 101)], "doc_id long, source string")
    governing = spark.createDataFrame([("big", 1)], "source string, place int")
    size, skip = spark.createDataFrame([(100,)], "n long"), owners.where("doc_id in (1, 99)").select("doc_id")
    got = I.seated_search(runs, owners, governing, size, skip).orderBy("rank").collect()
    order = [r.doc_id for r in got]
    assert order[:4] == [2, 98, 3, 97]  # each run's best first, in the order of the runs, without what is suppressed
    assert 1 not in order and 99 not in order and len(order) == len(set(order))
    depth = [r.doc_id for r in got if r.seat == "depth"]
    assert len(depth) == 24 and sum(i <= 60 for i in depth) == 6  # its share, and no more
    assert [r.doc_id for r in got if r.seat == "governing"] == [i for i in range(2, 41) if i not in depth][:6]


def test_all_questions_in_one_pass_give_each_ones_own_scores(spark):
    from provenir.operators import retrieval as R

    docs = spark.createDataFrame([(i, " ".join(["red fox"] * (i % 4) + ["blue bird"] * (i % 3) + ["word"] * (i % 7))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    got = I.lexical_runs(docs, [["fox"], ["bird", "fox"], ["absent"]], 10)
    for no, terms in ((0, ["fox"]), (1, ["bird", "fox"])):
        alone = R.ranked(R.bm25(docs, terms), [], k=10)
        assert sorted(map(tuple, got.where(F.col("run_no") == no).select("doc_id", "score", "rank").collect())) == sorted(map(tuple, alone.collect()))
    assert got.where("run_no = 2").count() == 0
