import random
import re

import numpy as np
import xxhash

from provenir.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    own = sorted(fps)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_fingerprints_of_odd_texts():
    for text in (None, "", " \t\n", "One", "ÀB c", "a b c d A", "x y z\x0bw", "　 q", "word " * 70000):
        assert simhash.fingerprint(text) == plain_fingerprint(text), repr(text)[:40]


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 40)
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(400)}
    for f in list(fps)[:40]:  # chains and dense balls
        g = f
        for _ in range(rnd.randint(1, 30)):
            g ^= 1 << rnd.randrange(64)
            fps.add(g)
    ball = rnd.getrandbits(64)
    fps |= {ball ^ (1 << i) ^ (1 << j) for i in range(0, 64, 2) for j in range(1, 24, 2)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    label = {x & (1 << 64) - 1: x & (1 << 64) - 1 for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        label[root(e.a & (1 << 64) - 1)] = root(e.b & (1 << 64) - 1)
    mine, theirs = {}, {}
    expected = plain_components(fps)
    for f in fps:
        mine.setdefault(root(f), set()).add(f)
        theirs.setdefault(expected[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the hunters in the wood " * 12
    rows = [(5, base), (3, base + "x"), (9, base), (7, "quite another text with words of its own"), (8, None), (2, ""), (11, " "), (None, base), (5, base)]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[8] == by[2] == by[11] == {("0" * 16, 2)}
    assert {c for _, c in by[5]} == {c for _, c in by[9]} == {c for _, c in by[None]}
    assert all(f == format(plain_fingerprint(dict(rows)[i] if i is not None else base), "016x") for i, v in by.items() for f, _ in v)
    kept = sorted(r.doc_id for r in simhash.representatives(df.where("doc_id is not null")).collect())
    assert 2 in kept and 8 not in kept and 7 in kept and len(kept) == len(set(kept))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_representatives_of_repeated_and_null_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(None, one), (None, two), (None, two), (4, three), (4, four), (3, three), (None, four), (4, four)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.representatives(df).collect()]
    assert sorted(kept, key=str) == sorted([(None, one), (None, two), (3, three), (4, four)], key=str)
