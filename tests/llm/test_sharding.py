import random
import zlib

import pytest

from provenir.llm import sharding


def held(rows, out, shards=16):
    assert sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in out)
    by = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_near_equal_bytes_and_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 300)
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(0, 200), rnd.choice("ab"), f"s{rnd.randint(0, 9)}") for i in range(3000)]
    rows += [(5000 + i, "same text" * 20, "a", f"s{i % 10}") for i in range(1500)]  # a third of all rows
    rows += [(9000 + i, f"pair {i // 2} " * 9, "b", f"s{i % 7}") for i in range(60)] + [(None, None, None, None), (1, "", "a", "s1"), (1, "", "a", "s1")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, size int, shard int")
    out = sharding.shards(df).collect()
    sizes = held([(r[0], r[1]) for r in rows], out)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(v - mean) for v in sizes.values()) < 0.02 * mean
    pairs = {}
    for r in out:
        if r.doc_id is not None and r.doc_id >= 9000:
            pairs.setdefault((r.doc_id - 9000) // 2, set()).add(r.shard)
    assert all(len(s) == 1 for s in pairs.values())


@pytest.mark.parametrize("n", [200, 1000, 10000])
def test_groups_that_fit_a_shard_stay_whole(spark, n):
    rnd = random.Random(n)
    rows = [(i, "y" * rnd.randint(1, 300) + (str(i) if i % 5 else "copy"), "a", f"s{rnd.randint(0, 9)}") for i in range(n)]
    rows += [(n + i, "a group of three quarters of a shard", "b", "s1") for i in range(3 * sum(len(r[1]) + 1 for r in rows) // 64 // 37)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    sizes = held([(r[0], r[1]) for r in rows], out)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(v - mean) for v in sizes.values()) < 0.02 * mean
    shards_of = {}
    for r in out:
        shards_of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in shards_of.values())


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    held([(1, "one"), (2, None)], sharding.shards(df).collect())
    assert sharding.shards(df.limit(0)).count() == 0
