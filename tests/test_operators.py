"""Fixtures of the corpus model: small literal frames and what must come out."""

from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.operators import ledger as L
from provenir.operators import retrieval as R
from provenir.operators import rules
from provenir.sources import pages as P


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bare_copy_is_suppressed_only_where_an_identified_one_stands(spark):
    df = spark.createDataFrame([(1, "a", "t", True), (2, "b", "t", False), (3, "c", "u", False), (4, "a", "v", True), (5, "b", "v", True), (6, "a", "w", False), (7, "a", "w", False)], "id long, owner string, text string, stands boolean")
    assert rows(L.bare_copies(df, "text", "owner", F.col("stands")), "id") == [(2,)]


def test_seats_keep_every_item_once_and_zero_seats_keep_the_order(spark):
    runs = spark.createDataFrame([(0, "lexical", 1, 1), (0, "lexical", 2, 2), (1, "dense", 9, 1), (1, "dense", 1, 2)], "run_no int, channel string, doc_id long, rank int")
    merged = R.fused(runs)
    seated = R.seated(runs, merged)
    assert rows(seated, "pos", "doc_id")[0] == (1, 1) and sorted(r[1] for r in rows(seated, "pos", "doc_id")) == [1, 2, 9]
    none = R.seated(runs, merged, seats=0)
    assert [d for _, d in rows(none, "pos", "doc_id")] == [r.doc_id for r in merged.orderBy(F.desc("score"), "doc_id").collect()]


def test_cap_moves_but_never_drops(spark):
    hits = spark.createDataFrame([(i, "s" if i < 8 else "t", i) for i in range(1, 10)], "doc_id long, source string, pos int")
    out = R.capped(hits, "source")
    assert [d for _, d in rows(out, "pos", "doc_id")] == [1, 2, 3, 4, 5, 6, 8, 9, 7]


def test_bm25_counts_headings_half_and_floors_common_terms(spark):
    df = spark.createDataFrame([(1, "tax tax", "x"), (2, "nothing", "tax"), (3, "other words", "y"), (4, None, None)], "doc_id long, text string, h string")
    got = dict(rows(R.bm25(df, ["tax"], heading="h"), "doc_id", "score"))
    assert set(got) == {1, 2} and got[1] > got[2] > 0


def test_damaged_vectors_fail_loudly(spark):
    import pytest

    df = spark.createDataFrame([(1, [1.0, float("nan")])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="damaged vector"):
        R.checked_vectors(df, 2).collect()


def test_first_gate_decides_and_unknown_is_not_false(spark):
    gates = (rules.Gate("A", "ruled out*", "a", "x > 1"), rules.Gate("B", "held", "b", "x = 3 or y"))
    df = spark.createDataFrame([(3, None, "en"), (3, None, "ru"), (None, True, "en"), (None, None, "en")], "x int, y boolean, language string")
    assert [(r.gate, r.outcome) for r in rules.decided(df, gates).collect()] == [("A", "ruled out"), ("A", "held"), ("B", "held"), (None, None)]


def test_sections_have_exact_offsets():
    body = "<h1>Act</h1><p>" + "word " * 90 + "</p><h2>Part 1</h2><p>" + "more " * 60 + "</p><footer>no</footer>"
    why, parts = P.sections(f"<html><body><nav>menu</nav>{body}</body></html>")
    assert why is None and [p[0] for p in parts] == ["Act", "Act > Part 1"]
    joined = "\n\n".join(p[1] for p in parts)
    assert all(joined[a:b] == text for _, text, a, b in parts)
    assert P.sections("<p>short</p>") == ("empty", []) and P.sections(None) == ("empty", [])
    assert P.sections("<a href=x>" + "link " * 200 + "</a>")[0] == "landing-page"


def test_longest_robots_rule_wins(spark):
    robots = spark.createDataFrame([("h", "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b # yes\nDisallow: /*.pdf$")], "host string, body string")
    urls = spark.createDataFrame([("h", p) for p in ("/a/x", "/a/b/c", "/z.pdf", "/z")] + [("free", "/a")], "host string, path string")
    assert rows(P.permitted(urls, P.robots_rules(robots)), "host", "path", "allowed") == [("free", "/a", True), ("h", "/a/b/c", True), ("h", "/a/x", False), ("h", "/z", True), ("h", "/z.pdf", False)]


def test_windows_overlap_and_reach_the_end():
    text = "Sentence one. " * 400
    spans = P.windows(text, 1000, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= 1000 for a, b in spans) and all(x[1] > y[0] for x, y in zip(spans, spans[1:]))
    assert P.windows("") == P.windows(None) == []


def test_upserts_and_versions(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, d string, e string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k long, d string, e string")
    assert rows(L.upserted(old, new, ["k"]), "k", "d", "e") == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert rows(L.superseded(old, new.where("k = 3"), ["k"], "d"), "k") == [(1,), (2,), (3,)]


def test_grams_are_counted_where_they_are_made(spark):
    from provenir.operators import retrieval as R

    docs = spark.createDataFrame([(1, "abcabc"), (2, "ABC"), (2, "abcd"), (3, None), (4, "ab")], "doc_id long, text string")
    found = R.postings(docs)
    assert sorted(map(tuple, found.collect())) == [("abc", 1, 2), ("abc", 2, 2), ("bca", 1, 1), ("bcd", 2, 1), ("cab", 1, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(gram" not in found._jdf.queryExecution().executedPlan().toString(), plan
