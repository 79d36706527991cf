"""Pairing of versions and the register shortlist on planted cases and against plain versions."""

import math
import random

from provenir.operators import shortlist as S
from provenir.operators import versions as V


def paired(a, b):
    """Three passes over the rows of one provision, one after the other."""
    left, right, out = list(a), list(b), []
    low = lambda s: " ".join((s or "").split()).lower()
    for k, match in enumerate((lambda x, y: low(x[1]) == low(y[1]) and low(x[2]) == low(y[2]), lambda x, y: low(x[1]) == low(y[1]), lambda x, y: True), 1):
        for x in list(left):
            y = next((y for y in right if match(x, y)), None)
            if y is not None:
                out.append((x[0], y[0], k))
                left.remove(x)
                right.remove(y)
    return out + [(x[0], None, 0) for x in left] + [(None, y[0], 0) for y in right]


def test_versions_are_paired_closest_first(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["k1", "k2", "k3", None]), i, rnd.choice(["6.1", "6.2", "7.1", None]), rnd.choice(["a  b", "A b", "c", None]), rnd.choice(["u", "v"])) for i in range(160)]
    form = "key string, id long, indicator string, quote string, url string"
    a, b = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    got = V.compared(spark.createDataFrame(a, form), spark.createDataFrame(b, form), ["key"], "id").collect()
    want = []
    for key in {r[0] for r in rows}:
        own = [[(r[1], r[2], r[3]) for r in side if r[0] == key] for side in (a, b)]
        want += [(key, *p) for p in paired(*own)]
    assert sorted(((r.key, r.first_id, r.second_id, r["pass"]) for r in got), key=str) == sorted(want, key=str)
    by = {r[1]: r for r in rows}
    for r in got:
        if r.found_by == "both":
            x, y = by[r.first_id], by[r.second_id]
            assert r.quote_differs == (" ".join((x[3] or "").split()).lower() != " ".join((y[3] or "").split()).lower())
            assert r.citation_differs == (x[4] != y[4]) and r.indicator_differs == (x[2] != y[2])
            assert (r.how_they_differ == "identical") == (not (r.quote_differs or r.citation_differs or r.indicator_differs))
        else:
            assert (r.second_id is None) == (r.found_by == "A") and "did not produce" in r.how_they_differ
    nothing = spark.createDataFrame([], form)
    assert V.compared(nothing, nothing, ["key"], "id").count() == 0
    assert {r.found_by for r in V.compared(nothing, spark.createDataFrame(b, form), ["key"], "id").collect()} == {"B"}


OWNERS = [
    ("companies", "Companies Act 1967", "act", [1.0, 0.0]),
    ("records", "Retention of records order", "order", [0.0, 1.0]),
    ("english", "Application of English Law Act", "act", [0.6, 0.8]),
    ("cyber", "Cybersecurity Act 2018", "act", None),
    ("bare", "Records law", "act", [0.8, 0.6]),
]
HEADINGS = [("companies", "Accounting records", 5, [0.0, 1.0]), ("companies", "Names of companies", 1, [1.0, 0.0]), ("english", "Short title", 1, [0.9, 0.1]), ("cyber", "Records of incidents and accounting records", 2, None), ("gone", "Records of the lost", 1, [0.0, 2.0])]


def register(spark):
    titles = spark.createDataFrame([(o, t, k, v, 9) for o, t, k, v in OWNERS], "owner string, title string, kind string, vector array<double>, rank int")
    headings = spark.createDataFrame(HEADINGS, "owner string, heading string, ordinal long, vector array<double>")
    return titles, headings


def test_vectors_of_owners(spark):
    titles, headings = register(spark)
    got = {r.owner: r.vector for r in S.owner_vectors(titles, headings, dims=2).collect()}
    assert set(got) == {"companies", "records", "english", "bare", "gone"}
    assert all(math.isclose(math.hypot(*v), 1) for v in got.values())
    assert [round(x, 6) for x in got["companies"]] == [round(x / math.hypot(2, 1), 6) for x in (2, 1)]
    many = spark.createDataFrame([("o", f"h{i}", i, [1.0, 0.0] if i < 24 else [0.0, 1.0]) for i in range(60)], "owner string, heading string, ordinal long, vector array<double>")
    assert S.owner_vectors(titles.where("false"), many, dims=2).first().vector == [1.0, 0.0]  # headings beyond the 24th do not count


def runs_of(spark, **more):
    titles, headings = register(spark)
    vectors = S.owner_vectors(titles, headings, dims=2)
    out = {}
    for r in S.channel_runs(titles, headings, vectors, [(["records", "accounting"], [0.0, 1.0])], **more).orderBy("run_no", "rank").collect():
        out.setdefault(r.channel, []).append((r.owner, r.matched))
    return out


def test_four_channels(spark):
    got = runs_of(spark)
    assert [o for o, _ in got["title-lexical"]] == ["bare", "records"]
    assert [o for o, _ in got["title-dense"]][:1] == ["gone"] and len(got["title-dense"]) == 5
    # an owner's place is its single best heading's, and the heading is named
    assert got["heading-lexical"] == [("companies", "accounting records"), ("cyber", "records of incidents and accounting records"), ("gone", "records of the lost")]
    assert got["heading-dense"][:2] == [("gone", "Records of the lost"), ("companies", "Accounting records")]


def test_a_kind_is_filtered_before_the_top(spark):
    got = runs_of(spark, kind="act", k=1)
    assert got["title-lexical"] == [("bare", None)] and got["title-dense"] == [("bare", None)]
    assert "gone" not in {o for own in got.values() for o, _ in own}


def test_the_shortlist_holds_half_for_the_primary_kind(spark):
    titles, headings = register(spark)
    vectors = S.owner_vectors(titles, headings, dims=2)
    questions = [(["records", "accounting"], [0.0, 1.0]), (["law"], [1.0, 0.0])]
    got = S.shortlist(titles, headings, vectors, questions, limit=4, primary="act").orderBy("rank").collect()
    owners = [r.owner for r in got]
    assert len(owners) == len(set(owners)) == 4 and [r["rank"] for r in got] == [1, 2, 3, 4]
    kinds = {o: k for o, _, k, _ in OWNERS}
    assert [kinds[o] for o in owners[:2]] == ["act", "act"]
    assert "gone" not in owners  # it is fetched, and has no title row
    plain = S.shortlist(titles, headings, vectors, questions, limit=4).orderBy("rank").collect()
    assert "accounting records" in {h for r in plain for h in r.matched_headings}
    assert S.shortlist(titles.where("false"), headings.where("false"), vectors.where("false"), questions).count() == 0


def test_owners_are_scored_by_the_runs_that_could_have_found_them(spark):
    runs = spark.createDataFrame([(0, "title-lexical", "a", 1, None), (0, "title-lexical", "b", 2, None), (2, "heading-lexical", "b", 1, "h"), (3, "heading-dense", "c", 1, "x")], "run_no int, channel string, owner string, rank int, matched string")
    titles = spark.createDataFrame([("a",), ("b",), ("c",)], "owner string")
    contents = spark.createDataFrame([("b",), ("c",), ("c",)], "owner string")
    got = {r.owner: (r.score, r.channels, r["rank"]) for r in S.pool(runs, titles, contents, 3).collect()}
    assert got == {"a": (round(1 / 61, 8), "title-lexical", 1), "b": (round((1 / 62 + 1 / 61) / 3, 8), "heading-lexical,title-lexical", 2), "c": (round(1 / 61 / 3, 8), "heading-dense", 3)}
