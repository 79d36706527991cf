import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import runs


def brute(words):
    """All runs by the definition: maximal stretches for each period, of which it is the smallest."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, length = i, j - i + p
            if length >= max(6, 4 * p) and not any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                out.append((start, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_of(doc_id, text):
    """What the query must return for a document, worked out plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for r in found:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(left))


def rows_of(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "row": F.lit("x")}).write.parquet(f"{path}/documents.parquet")
    return runs.op13_runs(spark, path).drop("n_words").collect()


@pytest.mark.parametrize("seed", range(6))
def test_slabs_of_short_alphabets_against_the_definition(seed):
    rnd = random.Random(seed)
    docs = []
    for _ in range(400):
        kind, n = rnd.randrange(4), rnd.randrange(0, 90)
        w = [rnd.choice("ab" if kind else "abc") for _ in range(n)]
        if kind == 2:
            root = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
            w = (w[:7] + root * rnd.randrange(2, 9) + root[: rnd.randrange(len(root))] + w[7:20])[:120]
        if kind == 3:
            root = ([*"aaaaaaab"] * 4 + [*"abab"] * 3)[: rnd.randrange(6, 40)]
            w = root * 5 + w[:5]
        docs.append([x.encode() for x in w])
    assert runs._slab(docs) == [brute(d) for d in docs]


def test_a_very_long_text_and_small_chunks(monkeypatch):
    monkeypatch.setattr(runs, "FIRST", 2)
    monkeypatch.setattr(runs, "MOST", 5)
    rnd = random.Random(5)
    w = [rnd.choice("abcdefgh") for _ in range(700)] + [*"abcdefghijk"] * 40 + ["x"] * 300 + [*"xy"] * 200
    assert runs._slab([[x.encode() for x in w]]) == [brute(w)]
    one = [b"w"] * 200_000 + [b"v"] + [b"w"] * 100_000
    assert runs._slab([one]) == [[(0, 200_000, 1), (200_001, 100_000, 1)]]


def test_query_rows_against_the_definition(spark, tmp_path):
    rnd = random.Random(9)
    texts = [None, "", " \t\n ", "one", "a a a a a a", "a a a a a", "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "é　é " * 9, "x y\n" * 20, "x y z " * 4 + "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (None, None), (3, "one"), (3, "one")]
    rows += [(100 + i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 150)))) for i in range(300)]
    rows += [(1000, "lead " + "a line of text\n" * 3000), (1001, " ".join(str(i % 977) for i in range(5000)))]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20
    order = lambda r: tuple((x is not None, x) for x in r)
    small = [r for r in rows if r[0] is None or r[0] < 1000]
    got = rows_of(spark, rows, tmp_path / "t")
    assert sorted((tuple(r) for r in got if r.doc_id is None or r.doc_id < 1000), key=order) == sorted((row_of(*r) for r in small), key=order)
    long = {r.doc_id: r for r in got if (r.doc_id or 0) >= 1000}
    assert zlib.crc32(b"1000") % 10 and (long[1000].start, long[1000].length, long[1000].period) == (1, 12000, 4)
    assert zlib.crc32(b"1001") % 10 and (long[1001].start, long[1001].length, long[1001].period) == (0, 5000, 977)


def test_an_empty_table(spark, tmp_path):
    assert rows_of(spark, spark.createDataFrame([], "doc_id long, text string").collect(), tmp_path / "e") == []


def test_many_documents_in_small_slabs(spark, monkeypatch):
    rows = [(i, "k l m " * (i % 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in runs.with_runs(df).collect()}
    for i, text in rows:
        assert [tuple(x) for x in got[i].runs] == brute(text.split()) and got[i].n_words == len(text.split())
        assert got[i].collapsed == ("k l m" if i % 30 >= 4 else " ".join(text.split()))
    assert np.array_equal(sorted(got), range(200))
