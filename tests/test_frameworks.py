"""Framework candidates: lists in turn, parents before children, against plain versions."""

import random

from provenir.operators import frameworks as W


def plain(lists, parents, live):
    lists = [[o for o in x if o in live] for x in lists]
    order = []
    for i in range(max(map(len, lists), default=0)):
        for x in lists:
            if i < len(x) and x[i] not in order:
                order.append(x[i])
    out = []
    for o in order:
        if o not in out:
            p = parents.get(o)
            if p is not None and p in live and p not in out:
                out.append(p)
            out.append(o)
    return order, out


def test_lists_in_turn_and_parents_first(spark):
    rnd = random.Random(11)
    names = [f"o{i}" for i in range(14)]
    cells, rows, want = range(25), ([], [], []), {}
    parents = {o: rnd.choice([p for p in names if p != o]) for o in names if rnd.random() < 0.6}
    live = set(rnd.sample(names, 11))
    for c in cells:
        lists = [rnd.sample(names, rnd.randint(0, 7)) for _ in range(3)]
        for k, x in enumerate(lists):
            rows[k].extend((c, o, 3 * i + 1, 100 * c + i) for i, o in enumerate(x))
        order, out = plain(lists, parents, live)
        if out:
            want[c] = (order, out, lists[1])
    form = "cell int, owner string, rank int, section long"
    register, sections, retrieved = (spark.createDataFrame(x, form) for x in rows)
    relation = spark.createDataFrame(list(parents.items()) + [("stray", "gone")], "owner string, parent string")
    force = spark.createDataFrame([(o,) for o in live], "owner string")
    got = {}
    for r in W.candidates(register.drop("section"), sections, retrieved.drop("section"), relation, force, ["cell"]).orderBy("cell", "rank").collect():
        got.setdefault(r.cell, []).append(r)
    assert {c: [r.owner for r in x] for c, x in got.items()} == {c: w[1] for c, w in want.items()}
    for c, x in got.items():
        order, _, second = want[c]
        assert [r["rank"] for r in x] == list(range(1, len(x) + 1))
        for r in x:
            assert (r.sections or []) == ([100 * c + second.index(r.owner)] if r.owner in second and r.owner in live else [])


def test_a_parent_moves_up_before_its_first_child(spark):
    listed = spark.createDataFrame([("c", "b", 1), ("c", "x", 2), ("c", "a", 3)], "cell string, owner string, place int")
    relation = spark.createDataFrame([("b", "a"), ("x", "y"), ("a", "z")], "owner string, parent string")
    force = spark.createDataFrame([("a",), ("z",)], "owner string")
    got = W.with_parents(listed, relation, force, ["cell"]).orderBy("rank").collect()
    assert [r.owner for r in got] == ["a", "b", "x"]  # y is not in force; a was placed for b, so its own parent is not asked for
    assert W.with_parents(listed.where("false"), relation, force, ["cell"]).count() == 0
