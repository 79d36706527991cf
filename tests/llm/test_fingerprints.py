import hashlib
import random
from collections import Counter

import pytest

from provenir.llm import fingerprints as fp


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


@pytest.mark.parametrize("held", [3, 1000])
def test_edits_and_likeness(spark, monkeypatch, held):
    monkeypatch.setattr(fp, "NEIGHBOURS", held)
    monkeypatch.setattr(fp, "SAMPLED", 40)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["ä", "bb", "the", "of", "x1", "y", "日本", "zz", "q", "longer"]) + (rnd.choice("abc") if rnd.random() < 0.5 else "") for _ in range(rnd.randint(1, 200))) for _ in range(40)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " "), (503, "😀"), (504, texts[3]), (505, texts[3]), (505, texts[3])]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, n_chars int, bucket int").repartition(3)
    out = sorted(fp.fingerprints(df, n=64).collect(), key=lambda r: r.doc_id)
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: r[0])]
    assert [r.doc_id for r in out] == [i for i, _ in rows]
    by_text = {}
    for (i, t), (_, following), r in zip(rows, rows[1:] + rows[:1], out):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert abs(r.near_edited - jaccard(t, edited)) < 0.26, (t, edited)
        assert abs(r.near_next - jaccard(t, following)) < 0.26
        assert (r.near_next == 1.0) == (t.split() == following.split() or jaccard(t, following) == 1)


def test_likeness_has_no_bias(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(5, 60))) for _ in range(150)]
    out = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=64).collect()}
    off = [out[i].near_next - jaccard(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]
    assert abs(sum(off) / len(off)) < 4 * 0.5 / (len(off) * 64) ** 0.5


def test_ids_far_apart_make_no_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(fp, "NEIGHBOURS", 100)
    rows = [(i, f"text {i}") for i in range(3000)] + [(1 << 60, "far"), (-(1 << 60), "near"), (None, "none")]
    near = fp.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(r["count"] for r in near.groupBy("bucket").count().collect()) < 400
    got = {r.doc_id: r.next_text for r in near.where("not extra").collect()}
    order = [None, -(1 << 60), *range(3000), 1 << 60]
    assert got == {i: dict(rows)[j] for i, j in zip(order, order[1:] + order[:1])}


def test_empty_and_single(spark):
    df = spark.createDataFrame([(None, "only one")], "doc_id long, text string")
    r = fp.fingerprints(df).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fp.fingerprints(df.limit(0)).count() == 0
