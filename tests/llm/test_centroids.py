import hashlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from provenir.llm import centroids


def brute(rows, clusters, dims, rounds):
    whole = lambda v: v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [Fraction(float(x)) * 64 // 1 for x in v], v) for i, v in rows if whole(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))[:clusters]
    c = [list(r[1]) for r in first]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, own)), j) for j, own in enumerate(c))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q, _ in kept]
        for j in range(len(c)):
            mine = [q for (_, q, _), k in zip(kept, own) if k == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *nearest(q)[::-1]) for i, q, _ in kept]
    return [(i, j, d if d < 1 << 63 else None) for i, j, d in out], c


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance string")


@pytest.mark.parametrize("size", [0.3, 40.0, 3e4, 2e6])
def test_against_brute_force(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-9, 10, 5) * size / 9).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(120)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 6), (904, [None] + [1.0] * 4), (905, [float("nan")] * 5), (906, [float("-inf")] * 5)]
    got, c = centroids.clustered(frame(spark, rows), clusters=9, dims=5)
    want, own = brute(rows, 9, 5, 3)
    assert c == own
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_immense_components_and_few_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-5, 6, 3) * s).tolist()) for i, s in enumerate([0.5] * 20 + [2.0**30] * 6 + [2.0**61] * 4 + [1e200] * 3)] + [(50, [1.7e308, -1.7e308, 0.0])]
    for n in (len(rows), 3):
        got, c = centroids.clustered(frame(spark, rows[:n]), clusters=5, dims=3, rounds=2)
        want, own = brute(rows[:n], 5, 3, 2)
        assert c == own and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    got, c = centroids.clustered(frame(spark, rows).where("false"), dims=3)
    assert got.count() == 0 and c == []


def test_the_shortlist_is_never_wrong():
    rng = np.random.default_rng(2)
    for size in (3, 1 << 12, 1 << 24, centroids._safe(64)):
        base = rng.integers(-size, size + 1, 64)
        c = [(base + rng.integers(-2, 3, 64)).clip(-size, size).tolist() for _ in range(12)] + [[centroids._safe(64) * 3] * 64]
        rows = (base + rng.integers(-3, 4, (200, 64))).clip(-size, size)
        screen = centroids.Screen(c)
        cluster, distance = screen.nearest(rows)
        exact = [min((sum((a - b) ** 2 for a, b in zip(q, own)), j) for j, own in enumerate(c)) for q in rows.tolist()]
        assert list(zip(distance.tolist(), cluster.tolist())) == exact
        if size == 3:
            assert screen.shortlist(rows).sum() < 12 * 200  # it does screen


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(centroids.OP12_SQL)
    names = [d[0] for d in want.description]
    got = centroids.op12_centroids(spark, f"/root/testdata/{sf}")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())
