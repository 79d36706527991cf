import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from provenir.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(histogram, capacity):
    bins = packing.plan(histogram, capacity)
    got = {}
    for times, content in bins:
        assert times > 0 and sum(k * n for k, n in content.items()) <= capacity
        for k, n in content.items():
            got[k] = got.get(k, 0) + times * n
    assert got == {k: n for k, n in histogram.items() if n}
    return sum(t for t, _ in bins), -(-sum(k * n for k, n in histogram.items()) // capacity)


def best_fit_decreasing(histogram, capacity):
    free, n = [0] * (capacity + 1), 0
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            room = next((r for r in range(k, capacity + 1) if free[r]), None)
            if room is None:
                n, room = n + 1, capacity
            else:
                free[room] -= 1
            free[room - k] += 1
    return n


def test_plans_are_close_to_the_bound():
    rnd = random.Random(5)
    assert packing.plan({}, 64) == []
    assert check_plan({64: 5}, 64) == (5, 5)
    assert check_plan({33: 10}, 64)[0] == 10
    assert check_plan({3: 100000, 5: 70000, 60: 1000}, 64)[0] <= 1.005 * (3 * 100000 + 5 * 70000 + 60 * 1000) / 64 + 2
    for _ in range(5):
        h = {k: rnd.randint(0, 3000) for k in range(1, 65)}
        n, _ = check_plan(h, 64)
        assert n <= 1.01 * best_fit_decreasing(h, 64)
    h = {k: rnd.randint(0, 2) for k in range(1, 700)}
    n, least = check_plan(h, 2048)
    assert n <= 1.01 * least + 1


def test_best_bin_is_exact():
    rnd = random.Random(2)
    for _ in range(50):
        length = np.array(sorted({rnd.randint(1, 12) for _ in range(4)}))
        count = np.array([rnd.randint(0, 3) for _ in length])
        value = np.array([rnd.random() for _ in length])
        got = packing.best_bin(length, count, value, 20)
        assert (got <= count).all() and got @ length <= 20
        best = max(sum(a * v for a, v in zip(x, value)) for x in np.ndindex(*(count + 1)) if sum(a * k for a, k in zip(x, length)) <= 20)
        assert abs(got @ value - best) < 1e-9


def test_pieces_and_places(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["one", "Zwei", "drei!", "x", "été"]) for _ in range(rnd.choice([1, 3, 50, 900, 5000]))) for _ in range(120)] + [None, "", "same", "same", "<|endoftext|>", "one <|endoftext|>two  <|endoftext|><|endoftext|>\n x", "<|endoftext| >"]
    rows = [(i if i != 7 else None, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    out = [r.asDict() for r in packing.packed(df, PATH).collect()]
    model = Tokenizer.from_file(PATH)
    expected = []
    for i, t, _ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(used) <= 1.02 * total / 2048 + 1
    assert packing.packed(df.limit(0), PATH).count() == 0
