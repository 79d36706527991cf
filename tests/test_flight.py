"""Streamed payloads of pages."""

import json

from pyspark.sql import functions as F

from provenir.sources import flight as S


def page(stream, cuts=(), raw=None):
    pieces = [stream[a:b] for a, b in zip((0, *cuts), (*cuts, len(stream)))]
    pushed = "".join(f"<script>self.__next_f.push([1,{json.dumps(p)}])</script>" for p in pieces)
    return "<html><script>self.__next_f=self.__next_f||[]</script>" + pushed + (raw or "") + "</html>"


def units(s):
    return len(s.encode("utf-16-le")) // 2


def test_rows_are_cut_by_their_lengths():
    one, two = '<h1>Act 😀 "quoted" \\ é</h1>\n3:["not a row"]', "<p>1. A person\n shall</p>"
    stream = f'0:["$","div",null]\n1a:T{units(one):x},{one}2:I["module"]\n2b:T{units(two):x},{two}3:T5,plain'
    for cuts in ((), (3,), (5, 17, 40)):
        assert S.markup(page(stream, cuts)) == one + "\n" + two
    assert S.markup(page("0:T5,plain")) is None and S.markup("<html>none</html>") is None and S.markup(None) is None and S.markup("") is None
    assert S.markup(page(stream, (), '<script>self.__next_f.push([1,"bad \\x piece"])</script>')) is None
    assert S.markup(page("1:Tffff,<p>cut short")) == "<p>cut short"


def test_columns(spark):
    html = page("1:Tb,<p>text</p>")
    df = spark.createDataFrame([(1, html), (2, "<p>as served</p>"), (3, None)], "id int, html string")
    got = {r.id: r.body for r in S.served_or_streamed(df).collect()}
    assert got == {1: "<p>text</p>", 2: "<p>as served</p>", 3: None}
    assert df.where("false").select(S.flight_markup(F.col("html"))).count() == 0
