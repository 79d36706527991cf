import random

import corpus_pipeline
from provenir.llm import jaccard


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stage_links_all_pairs_of_likeness_four_fifths(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = [None, " ", "one two", "ONE two", "one three"]
    for base in range(12):
        now = [word() for _ in range(rnd.choice((60, 200, 500)))]
        texts.append(" ".join(now))
        for _ in range(10):  # copies of copies, more and more words apart
            now = list(now) if rnd.random() < 0.6 else texts[rnd.randrange(5, len(texts))].split()
            for _ in range(rnd.randint(0, max(1, len(now) // 40))):
                now[rnd.randrange(len(now))] = word()
            texts.append(" ".join(now))
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({root(i) for i in range(len(texts))})
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_likeness_is_exact():
    x, y = ("a b c d e f g h i j k l m", "a b c d e f g h i j k l z")
    assert jaccard.likeness(jaccard.shingles(x), jaccard.shingles(y)) == 8 / 10


def test_fingerprints_propose_first(spark, monkeypatch):
    """Near copies within three bits are found by the fingerprints' index alone, and nothing unlike is linked."""
    rnd = random.Random(8)
    now = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(now), " ".join([*now, "more"]), " ".join(now[:1500]), "other words of their own that are here"]
    monkeypatch.setattr(jaccard, "_likely", lambda frames: (f.loc[[], ["a", "b"]] for f in frames))
    monkeypatch.setattr(jaccard, "TRIES", ())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]


def test_proposed_pairs_connect_close_fingerprints(spark):
    rnd = random.Random(9)
    fps = [rnd.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << rnd.randrange(62)) ^ (1 << rnd.randrange(62)) for f in fps[:20]] + fps[:5]
    nodes = list(enumerate(fps, 100))
    group = {n: n for n, _ in nodes}
    got = dict(group)
    for own, pairs in ((group, [(m, n) for m, x in nodes for n, y in nodes if (x ^ y).bit_count() <= 3]), (got, [(r.a, r.b) for r in jaccard.proposed(spark.createDataFrame(nodes, "node long, fp long")).collect()])):
        for _ in range(8):
            for m, n in pairs:
                own[m] = own[n] = min(own[m], own[n])
    assert got == group
