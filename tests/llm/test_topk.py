import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import topk


def brute(rows, k):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        own = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_slices_give_the_scores():
    rng = np.random.default_rng(1)
    rows = rng.integers(-40, 40, (200, 9))
    index = topk.Slices(rows)
    for query in rng.integers(-64, 64, (20, 9)):
        planes = index.score_slices(query)
        total = sum(np.unpackbits(p.view(np.uint8), bitorder="little")[:200].astype(np.int64) << i for i, p in enumerate(planes))
        exact = rows @ query
        assert len(set(total - exact)) == 1


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 70)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = np.random.default_rng(4)
    vecs = (rng.integers(-3, 4, (300, 6)) / 8).tolist()
    rows = [(i, v) for i, v in enumerate(vecs)]
    rows += [(1000 + i, vecs[7]) for i in range(100)]  # one vector many times
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, vecs[1]), (5, vecs[5]), (20, vecs[21]), (2040, [1.0, 2.0]), (2041, [0.5, 0.5]), (2042, [])]
    df = spark.createDataFrame([(i, None if v is None else v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dims int, block int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 20))
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 20 == 0).collect())) == sorted(brute([r for r in rows if r[0] is not None and r[0] < 5], 20))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_immense_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 3) * s).tolist()) for i, s in enumerate([0.5] * 10 + [2.0**18] * 10 + [2.0**20] * 10 + [2.0**26] * 10)]
    rows.append((41, [2.0**26, -(2.0**24), 1.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 30)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 30))
    wide = [(0, [2.0**56, 0.0]), (1, [0.0, 2.0**56]), (2, [1.0 / 64, -0.5])]
    got = topk.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 30)
    assert sorted(map(tuple, got.collect())) == sorted(brute(wide, 30))


def test_what_fits_no_long_is_an_error(spark):
    for rows in ([(0, [2.0**40]), (1, [2.0**40])], [(0, [1.0]), (1, [2.0**60])]):
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
