"""Lines that repeat at the edges of pages."""

from provenir.sources import furniture as S


def lines_of(pages, doc="d"):
    return [(doc, p, i, x) for p, own in enumerate(pages) for i, x in enumerate(own)]


def left(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc string, page int, i int, line string, n int")
    out = {}
    for r in S.without_furniture(df).orderBy("doc", "page", "i").collect():
        out.setdefault((r.doc, r.page), []).append(r.line)
    return out


def body(p):
    return [f"words only of {'abcdefgh'[p] * 5} {k}" for k in "uvwx"]


def test_heads_feet_and_numbers_go(spark):
    pages = [[f"LAWS OF EXAMPLE  No. {p}", *body(p), f"Data Act (revised {p})", f"Page {p} of 8"] for p in range(8)]
    got = left(spark, lines_of(pages))
    assert all(got["d", p] == body(p) for p in range(8))


def test_what_stays(spark):
    start = ["1. Short title", "PART II"]
    pages = [[*start, *body(p), f"seen on two {p}" if p < 2 else f"line {'abcdefgh'[p] * 3}", "x" * 130] for p in range(8)]
    got = left(spark, lines_of(pages))
    assert all(got["d", p] == pages[p] for p in range(8))  # structure, rare lines and long lines
    few = [["HEAD OF IT", *body(p), "12"] for p in range(3)]
    assert all(left(spark, lines_of(few))["d", p] == few[p] for p in range(3))  # too few pages
    short = [["HEAD OF IT", "one", "two", "three", "four"] for _ in range(8)]
    assert all(left(spark, lines_of(short))["d", p] == short[p] for p in range(8))  # too few lines
    inner = [[*body(p)[:2], "the same words", *body(p)[2:], "the end of " + "abcdefgh"[p] * 4] for p in range(8)]
    assert all(left(spark, lines_of(inner))["d", p] == inner[p] for p in range(8))  # not at an edge
    numbers = [[*body(p), f"odd {'abcdefgh'[p] * 4}", str(p)] if p < 4 else [*body(p), "zz " + "abcdefgh"[p] * 4, "yy " + "hgfedcba"[p] * 5] for p in range(8)]
    assert left(spark, lines_of(numbers))["d", 0][-1] == "0"  # numbers on half of the pages only


def test_nulls_and_an_empty_table(spark):
    rows = [("d", p, i, None if i == 0 else f"HEAD OF IT" if i == 1 else f"{'abcdefgh'[p]} text {i}") for p in range(6) for i in range(7)]
    got = left(spark, rows)
    assert all(None in got["d", p] and "HEAD OF IT" not in got["d", p] for p in range(6))
    assert left(spark, []) == {}
