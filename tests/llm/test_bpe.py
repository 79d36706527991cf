import base64
import random

import public_tokenizers
import pytest

from provenir.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    import numpy as np

    return np.frombuffer(own.encode(text), "<u4").tolist()


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_equals_tiktoken_on_random_texts(plain):
    own, rnd = bpe.Codec(RANKS), random.Random(7)
    parts = ["a", "aa", "B", " ", "  ", "\n", " ", "　", "é", "é", "日本", "😀", "'s", "'", "1", "٣", "_", "--", "<|endoftext|>", "\t", "\x00"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) * rnd.randint(1, 4) for _ in range(rnd.randint(0, 14)))
        assert ids(own, text) == plain.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text


def test_long_texts_and_a_small_memory(plain, monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", 50)
    monkeypatch.setattr(bpe, "CACHE", 8)
    own, rnd = bpe.Codec(RANKS), random.Random(3)
    text = "".join(rnd.choice(["word", "  ", " x", "\n\n ", "12", "ü", " longer"]) for _ in range(3000))
    assert ids(own, text) == plain.encode_ordinary(text)
    blob = "ab" * 4000
    assert ids(own, blob) == plain.encode_ordinary(blob)


def test_offsets_cover_the_text(plain):
    own, text = bpe.Codec(RANKS), "Ein Maß 😀 für alle 日本語"
    at = own.offsets(text, own.encode(text))
    assert at[0][0] == 0 and at[-1][1] == len(text)
    assert (at[1:, 0] <= at[:-1, 1]).all()


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    out = bpe.digests(df, RANKS).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out) == [0, 0, 1, 2, 2]
    back = bpe.decoded(bpe.encoded(df, RANKS), RANKS).collect()
    assert sorted(r.text for r in back) == ["", "", "a b", "a b", "x"]
    assert bpe.digests(df.limit(0), RANKS).count() == 0


def test_an_idle_worker_forgets_and_learns_again(plain, monkeypatch):
    import time

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    own, texts = bpe.Codec(RANKS), ["some words here", "and  other\n words", None]
    first = own.encode_all(texts)
    assert own.led
    for _ in range(50):
        if not own.led:
            break
        time.sleep(0.1)
    assert not own.led and not own.bare
    assert own.encode_all(texts) == first and own.led


def test_what_is_new_in_many_texts_goes_to_the_library_at_once(plain, monkeypatch):
    own, calls = bpe.Codec(RANKS), []
    texts = [f"Begin{chr(97 + i % 26) * (1 + i // 26)}, word{chr(97 + i % 26)} naïve\nlines  and 日本 {i}" for i in range(120)]

    class Counted:
        def encode_batch_fast(self, *args, **kwargs):
            calls.append(1)
            return model.encode_batch_fast(*args, **kwargs)

    model, own.model = own.model, Counted()
    assert [own.decode(i) for i in own.encode_all(texts)] == texts
    assert len(calls) <= 4
    assert [list(memoryview(i).cast("I")) for i in own.encode_all(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_cuts_are_those_of_the_pattern():
    import numpy as np
    import regex

    rnd, matches = random.Random(11), regex.compile(bpe.PATTERN).findall
    parts = ["a", "B", "sev", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "​", "é", "ß", "×", "ª", "²", "½", "日本", "😀", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'r", "'S", "1", "٣", "_", "́", "\U00010400", "."]
    for _ in range(4000):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(0, 4))]
        pieces = [(p.encode(), k) for k, t in enumerate(texts) for p in matches(t)]
        ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
        want = sorted({*np.cumsum([0, *(len(p) for p, _ in pieces)]).tolist(), *ends.tolist()})
        assert bpe.cuts("".join(texts).encode(), ends).tolist() == want, texts


def test_a_piece_that_stands_often_is_looked_up_once(plain):
    own, asked = bpe.Codec(RANKS), []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    own.led = own.bare = Counted()
    texts = ["one word, and\none word. " * 40 + f"it's {i}" for i in range(50)]
    assert [list(memoryview(i).cast("I")) for i in own.encode_all(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert len(asked) == len(set(asked)) < 70


def test_parts_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "AT_ONCE", 10)
    texts = ["x" * 25, None, "", "seven", "y" * 6, "z", None, "w" * 9]
    batch = pa.record_batch([pa.array(range(10, 18)), pa.array(texts)], ["doc_id", "text"])
    for own in (batch, batch.slice(2), batch.slice(3, 2), batch.slice(0, 0)):
        got = list(bpe.parts(own))
        assert [t for p in got for t in p.column(1).to_pylist()] == own.column(1).to_pylist()
        assert all(sum(len(t or "") for t in p.column(1).to_pylist()[1:]) < 10 for p in got)
