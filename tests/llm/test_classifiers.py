import random

import numpy as np
import pytest

from provenir.llm import quality, toxicity


KINDS = (["wukkon", "Zibbel", "плохо"], ["xqzzab", "xqzzel", "ひどい"])


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ba", "lo", "mi", "ten", "ra"]) for _ in range(rnd.randint(2, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        toxic, good = int(rnd.random() < 0.2), int(rnd.random() < 0.7)
        if toxic:  # one of two kinds of abuse, in words that no list could know
            for _ in range(3):
                own[rnd.randrange(len(own))] = rnd.choice(KINDS[rnd.randrange(2)])
        text = " ".join(own) if good else " ".join(w.upper() + "!!" for w in own)
        out.append((i, text, good, toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1500, 1)
    odd = [(9000, None), (9001, ""), (9002, "wukkon " * 50000), (None, "no id"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "k", 0.5) for i, t, _, _ in rows] + [(*r, "k", 0.5) for r in odd], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, g, x) for i, _, g, x in rows if i % 2 == 0] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_chain_on_documents_it_has_not_seen(tables):
    rows, docs, labels = tables
    out = toxicity.with_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    got = {r.doc_id: r.is_toxic for r in out}
    unseen = [(i, x) for i, _, _, x in rows if i % 2 == 1]
    assert np.mean([got[i] for i, x in unseen if x]) > 0.95 and np.mean([got[i] for i, x in unseen if not x]) < 0.02
    assert got[9002] and not got[9000] and not got[9001]


def test_later_links_read_earlier_probabilities():
    rows = corpus(600, 2)
    toxic = np.array([x for *_, x in rows], float)
    found = [toxicity.features(t) for _, t, _, _ in rows]
    chain = toxicity.split_weights(toxicity.fit_chain(found, toxic))
    assert [len(w) for w in chain] == [toxicity.FEATURES + k + 1 for k in range(len(toxicity.CHAIN))]
    assert any(abs(w) > 1e-6 for w in chain[-1][toxicity.FEATURES : -1])


def test_kinds_come_from_the_labelled_rows():
    rnd = random.Random(5)
    texts = [" ".join([*(rnd.choice(["la", "li", "lo", "lu"]) for _ in range(20)), *(KINDS[k] if k < 2 else [])]) for k in (i % 6 for i in range(900))]
    toxic = np.array([float(i % 6 < 2) for i in range(900)])
    got = toxicity.kinds(toxicity.Rows([toxicity.features(t) for t in texts]), toxic)
    first, second = got[0::6], got[1::6]
    assert got[toxic == 0].max() == 0 and (first == first[0]).all() and (second == second[0]).all()
    assert first[0].any() and second[0].any() and not (first[0] * second[0]).any()
    assert not toxicity.kinds(toxicity.Rows([]), np.empty(0)).size


def test_columns_that_clash_give_way(spark, tables):
    _, docs, labels = tables
    odd = docs.limit(20).selectExpr("doc_id", "text", "1 as p_toxic", "'x' as is_toxic", "2 as `a.b`", "3 as _mark", "4 as x")
    out = toxicity.with_toxicity(odd, labels, docs)
    assert out.columns == ["doc_id", "text", "a.b", "_mark", "x", *(f"p_{c}" for c in toxicity.CHAIN), "is_toxic"] and out.count() == 20
    assert quality.with_quality(odd, labels, docs).columns == [*odd.columns, "score", "predicted"]


def test_quality_on_held_out_documents(tables):
    rows, docs, labels = tables
    out = quality.with_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    got = {r.doc_id: r.score for r in out}
    unseen = [(i, g) for i, _, g, _ in rows if i % 2 == 1]
    assert np.mean([(got[i] >= 0.7) == g for i, g in unseen]) > 0.97


def test_no_labels_and_no_rows(tables):
    _, docs, labels = tables
    none = labels.limit(0)
    assert not any(r.is_toxic for r in toxicity.with_toxicity(docs.limit(5), none).collect())
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.with_quality(docs.limit(5), none).collect())
    assert quality.with_quality(docs.limit(0), labels).count() == 0 == toxicity.with_toxicity(docs.limit(0), labels).count()


def test_context_sums_are_those_of_all_neighbours(spark):
    texts = ["a b c", "b a", None, "c"]
    got = quality.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    index, plain = quality.index_vectors(), np.zeros((quality.WORDS, quality.WIDTH))
    for t in texts:
        at = [quality.word_row(w) for w in (t or "").split()]
        for i, j in zip(at, at[1:]):
            plain[i] += index[j]
            plain[j] += index[i]
    norm = np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, plain / norm, atol=1e-5)


def test_pooling_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "MEMORY", 40)  # it starts anew now and then
    rnd = random.Random(8)
    index, context = quality.index_vectors(), np.random.default_rng(1).normal(size=(quality.WORDS, quality.WIDTH)).astype(np.float32)
    for _ in range(20):
        texts = [" ".join(rnd.choice(["one", "TWO", "two", "3", "!!!!", "x1", "Ä", "日本", "...", "one"]) for _ in range(rnd.randint(0, 60))) for _ in range(5)] + [None, ""]
        for text, got in zip(texts, quality.pooled(texts, index, context)):
            tokens = quality.TOKEN.findall(text or "")
            n, marks = max(len(tokens), 1), []
            for k, w in enumerate(tokens):
                mark = quality.shape_of(w)
                if mark is None and w.isalpha() and w in tokens[max(0, k - 2) : k]:
                    mark = "<again>"
                marks += [mark] if mark else []
            rows = [quality.word_row(w) for w in tokens]
            shape = sum((np.sqrt(marks.count(m) / n) * index[quality.hashed_to(m, quality.WORDS)] for m in set(marks)), np.zeros(quality.WIDTH))
            plain = np.concatenate([sum((context[r] for r in rows), np.zeros(quality.WIDTH)) / n, sum((index[r] for r in rows), np.zeros(quality.WIDTH)) / n, shape, [np.log1p(len(tokens)) / 5, len(set(rows)) / n, np.log1p(len(text or "")) / 8]])
            assert np.allclose(got, plain, atol=1e-4)
