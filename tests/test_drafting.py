"""Drafting facts and rationales on planted provisions."""

from pyspark.sql import functions as F

from provenir.functions import drafting as D


def values(spark, rows, f):
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "i int, text string, words string")
    got = {r.i: r.v for r in df.select("i", f(F.col("text"), F.col("words")).alias("v")).collect()}
    return [got[i] for i in range(len(rows))]


def check(spark, rows, f):
    assert values(spark, rows, f) == [r[-1] for r in rows]


def test_amendments(spark):
    check(spark, [("The principal Act is amended in section 3", None, True), ("x" * 500 + " the Act is amended", None, False), ("A person is amended", None, False), ("Amendment of section 4", None, True), (None, None, False)], lambda t, w: D.amends_another(t))


DEFINITIONS = "2. In this Act—\n“carrier” means a person who carries\n(a) goods; or\n(b) data;\n“data” includes records of any kind.\n\nA person must keep data safe."


def test_definitions(spark):
    rows = [(DEFINITIONS, "a person who carries", True), (DEFINITIONS, "(b) data", True), (DEFINITIONS, "records of any kind", True), (DEFINITIONS, "must keep data safe", False), (DEFINITIONS, "In this Act", False), (DEFINITIONS, "“data” includes records", True), (DEFINITIONS, "not there", False), (DEFINITIONS, None, False), (None, "goods", False), (DEFINITIONS, "a", False)]
    check(spark, rows, D.cites_definition)


def test_figures_left_open(spark):
    text = "goods of a value not exceeding $1,000, or such other\namount as is prescribed, and a fee of $250"
    check(spark, [(text, "not exceeding $1,000", True), (text, "a fee of $250", False), (text, "no figure", False), (text, None, False), (None, "$1,000", False), ("$10 of the goods that are listed there or such other amount as is prescribed", "$10", False)], D.figure_replaceable)


def test_powers(spark):
    rows = [
        ("The Minister may by order require:\n(a) a licence; and\n(b) a fee.", "(b) a fee", True),
        ("A person shall not:\n(a) export data.", "export data", False),
        ("A person who may act shall:\n(a) keep data.", "keep data", False),
        ("The Minister may require: (a) a fee. The carrier must keep data.", "must keep data", False),
        ("A person must act. The Minister may require: (a) a fee", "(a) a fee", True),
        ("no list", "no list", False),
        (None, "x y z", False),
    ]
    check(spark, rows, D.inherits_power)


def test_words_that_are_inserted(spark):
    text = "Section 3 is amended by inserting after subsection (1) the following:\n“(1A) A carrier must keep\n data.” and it must pay."
    check(spark, [(text, "A carrier must keep data", True), (text, "it must pay", False), (text, "Section 3 is amended", False), (text, None, False), (None, "data", False)], D.inserts_words)


def test_words_count_at_any_of_their_places(spark):
    text = "The principal Act is amended by inserting after section 3 the following: “ing\\E is.”"
    check(spark, [(text, "ing", True), (text, "ing\\E is", True), (text, "section", False), ("ing", "ing", False)], D.inserts_words)
    check(spark, [("In this Act—\n“carrier” means one who carries;\n“line” includes car;\n\nThe rest.", "car", True), ("car, “line” includes data", "car", False)], D.cites_definition)
    check(spark, [("A carrier must act. The Minister may by order require:\n(a) act", "act", True), ("A carrier must act. The act may be.", "act", False)], D.inherits_power)


def test_force_and_what_is_amended(spark):
    df = spark.createDataFrame([(1, ["Licensees must comply with all\nguidelines issued"]), (2, ["Non-compliance may result in enforcement action", "It is not legally binding"]), (3, ["plain"]), (4, None), (5, [])], "i int, head array<string>")
    assert {r.i: r.v for r in df.select("i", D.states_force(F.col("head")).alias("v")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    rows = [
        ("The Sales Tax (Goods) Order 2018 [P.U. (A) 210/2018], which is referred to as the “principal Order” in this Order, is amended", ("Sales Tax (Goods) Order 2018", "P.U. (A) 210/2018")),
        ("An Act to amend the Data Act 2012 [Act 26 of 2012] and to", ("Data Act 2012", "Act 26 of 2012")),
        ("nothing here", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string")
    got = {r.i: r.v and tuple(r.v) for r in df.select("i", D.amends_what(F.col("text")).alias("v")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1] for r in rows]


def test_rationales(spark):
    form = "i int, score double, criterion string, reason string, basis array<struct<quote:string,cited:string,heading:string>>, asked string, absence struct<governing:boolean,instrument:string,findings:int,current_to:string>, n int, m int, excluded int, exception string"
    rows = [
        (1, 0.5, "Some limits", "one limit", [("must keep data", "Data Act", "s 3"), ("other", "Act", "s 4")], "Local Storage", None, 4, 9, 2, "Excludes government data."),
        (2, 0.0, "None", "no measure", [], "Local Storage", (True, "Data Act", 3, "2024"), 4, 9, 0, "x"),
        (3, 0.0, "None", "no measure", None, "Local Storage", (False, "Data Act", None, None), 4, 9, 0, None),
        (4, 0.0, "None", "no measure", [], "Local Storage", None, 4, 9, 1, None),
    ]
    df = spark.createDataFrame(rows, form)
    c = F.col
    got = {r.i: r.v for r in df.select("i", D.rationale(c("score"), c("criterion"), c("reason"), c("basis"), c("asked"), c("absence"), c("n"), c("m"), c("excluded"), c("exception")).alias("v")).collect()}
    tail = 'Scored 0.0 -- "None". No measure across 4 provision(s) read for this indicator, out of 9 in the corpus.'
    assert got == {
        1: '"must keep data" (Data Act, s 3). Scored 0.5 -- "Some limits": one limit. 2 measure(s) were found and not scored: Excludes government data.',
        2: f"Data Act regulates this area -- 3 requirement(s) of this pillar were read in it -- and imposes no local storage. The text read is the published consolidation, current to 2024. {tail}",
        3: f"No instrument in the corpus was found to regulate this area. The most relevant one the search returned, Data Act, imposes no local storage. {tail}",
        4: tail,
    }
