"""Byte-level BPE: encoding and decoding over Arrow batches with the tokenizers library.

Numpy finds where the pattern of the vocabularies cuts many texts, Arrow numbers the different pieces,
each of these is looked up once in a bounded cache, and only unseen ones go to the library, many at a
time. Which ids belong to which piece follows from the byte lengths of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import threading
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The pattern of the public byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What the pattern tells apart; everything else is OTHER.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pieces that a worker remembers; beyond it the memory starts anew.
CACHE = 1_200_000
#: Seconds after which a worker that encodes no more lets go of its memory (it is used again for other work).
IDLE = 10
#: Bytes of text that are encoded together.
AT_ONCE = 4 << 20
#: Characters of a text that are handled at a time.
SPAN = 1 << 20


def byte_table() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for each code point."""
    import regex

    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(of, every):
            out[m.start() : m.end()] = kind
    return out


def cuts(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN begin in texts that stand one behind another (as UTF-8), and the end of all.

    ``ends``: where each text begins, and the end of all.
    """
    n, data = len(text), np.frombuffer(text + b"\0\0", np.uint8)
    kind = np.frombuffer(bytearray(text.translate(kinds()[:256].tobytes())), np.uint8)
    beyond = np.flatnonzero(data >= 0x80)
    lead = beyond[data[beyond] >= 0xC0]
    if len(lead):  # the bytes of a character are of its kind
        first = data[lead]
        length = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = (first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint8)[length]).astype(np.int32)
        for k in (1, 2, 3):
            more = np.flatnonzero(length > k)
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        kind[beyond] = np.repeat(kinds()[code], length)
    own = np.zeros(n + 3, bool)  # where a text begins
    own[ends] = True
    space, blank = kind == SPACE, data[:n] == 0x20
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) & (space[1:] | ~blank[:-1])  # one blank goes with what follows it
    last = np.zeros(n + 1, bool)  # of a run of white space before something else: it stands alone
    last[1:n] = space[:-1] & ~space[1:] & ~own[1:n]
    last = last[1:]
    wide = beyond[last[beyond]]  # where its last byte is not its first
    last[wide] = False
    last[lead[np.searchsorted(lead, wide, "right") - 1]] = True
    cut[:n] |= last
    quote = np.flatnonzero(data[:n] == 0x27)
    quote = quote[own[quote] | (kind[quote - 1] != OTHER) & ~blank[quote - 1]]
    quote = quote[~own[quote + 1]]
    after, second = data[quote + 1], data[quote + 2]
    short = quote[np.isin(after, list(b"stmd"))]
    long = quote[((after == 0x6C) & (second == 0x6C) | np.isin(after, list(b"rv")) & (second == 0x65)) & ~own[quote + 2]]
    cut[short + 1], cut[short + 2], cut[long + 1], cut[long + 3] = False, True, False, True
    return np.flatnonzero(cut | own[: n + 1])


def _from_ranks(path: str):
    """A tokenizers model from a file of ranks: every way to put a token together is a merge."""
    from tokenizers import Tokenizer, models

    chars = byte_table()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    name = {k: "".join(map(chars.__getitem__, k)) for k in ranks}
    merges = [(name[k[:i]], name[k[i:]]) for k in sorted(ranks, key=ranks.get) for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
    return Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))


class Codec:
    """Encoder and decoder of one vocabulary file (``.json`` of tokenizers or ``.tiktoken`` ranks)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path) if path.endswith(".json") else _from_ranks(path)
        #: A file of ranks has no special tokens; with those of a JSON file the whole text goes to the library as it stands.
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items()}
        self.whole = Tokenizer.from_file(path) if self.special else None
        self.apart = "|".join(map(re.escape, self.special))
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = None  # pieces go to it in the characters of the vocabulary, one a byte
        self.chars = dict(enumerate(byte_table()))
        byte = {c: b for b, c in enumerate(byte_table())}
        words = self.model.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_of[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes_of += [b""] * (i + 1 - len(self.bytes_of))
            self.bytes_of[i] = word.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.led = self.bare = {}  # pieces to their ids (one memory under both names)
        self.lock, self.used, self.watched = threading.Lock(), 0.0, False

    def _watch(self) -> None:
        """Forget the pieces once nothing has been encoded for a while."""
        while True:
            time.sleep(IDLE / 2)
            with self.lock:
                if time.monotonic() - self.used > IDLE:
                    self.led = self.bare = {}
                    self.watched = False
                    return

    def _ids(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece (in the characters of the vocabulary), many pieces to a call of the library."""
        lists = [pieces[at : at + 512] for at in range(0, len(pieces), 512)]
        for own, e in zip(lists, self.model.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            cut = (4 * (np.searchsorted(np.cumsum(self.length_of[ids]), ends) + 1)).tolist()
            data = ids.astype("<u4").tobytes()
            yield from [data[a:b] for a, b in zip([0, *cut], cut)]

    def _named(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.chars)

    def _learn(self, new: list[str]) -> None:
        if len(self.led) + len(new) > CACHE:
            self.led.clear()
        self.led.update(zip(new, self._ids([p.replace(" ", self.chars[0x20]) if p.isascii() and p.isprintable() else self._named(p) for p in new])))

    def _spans(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SPAN:
            to = re.compile(r"\S(?=\s)").search(text, at + SPAN)
            if to is None:
                break
            yield text[at : to.end()]
            at = to.end()
        yield text[at:] if at else text

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these (different) pieces; those that the memory does not hold are learned together."""
        if len(pieces) > CACHE:
            return [ids for at in range(0, len(pieces), CACHE) for ids in self._found(pieces[at : at + CACHE])]
        found = list(map(self.led.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            self._learn([pieces[k] for k in missing])
            for k in missing:
                found[k] = self.led[pieces[k]]
        return found

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers; ``parts`` bounds what is given at a time."""
        with self.lock:
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._watch, daemon=True).start()
            try:
                return self._encode_all(texts)
            finally:
                self.used = time.monotonic()

    def _encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        apart = pc.greater(pc.binary_length(texts), SPAN)
        if self.special:
            apart = pc.or_(apart, pc.match_substring_regex(texts, self.apart))
        plain = iter(self._pieced(texts.filter(pc.invert(apart))))
        return [self.encode(texts[k].as_py()) if alone else next(plain) for k, alone in enumerate(apart.to_pylist())]

    def _pieced(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts without special tokens: each different piece is looked up once, Arrow puts them in their places."""
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]])
        ends = ends - ends[0]
        at = cuts(data, ends)
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        found = self._found(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(at, ends)].tolist() if len(ids) else [0] * len(ends)
        out = memoryview(ids.buffers()[2] or b"")
        return [bytes(out[a:b]) for a, b in zip(stops, stops[1:])]

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if self._has_special(text or ""):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(ids for span in self._spans(text or "") for ids in self._pieced(pa.array([span], pa.string())))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text; characters whose bytes stand in several tokens are put together again."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """For each token the characters that it touches: start and end (a split character counts for each part)."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.cumsum(self.length_of[np.frombuffer(ids, "<u4")])
        starts = ends - self.length_of[np.frombuffer(ids, "<u4")]
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        return np.stack([char[starts], char[ends - 1] + 1], axis=1) if len(ends) else np.empty((0, 2), np.int64)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a Python worker and file."""
    return Codec(path)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (id, text) with about AT_ONCE bytes of text each, one row at least."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
    at = [0, *(np.flatnonzero(np.diff(size // AT_ONCE)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(at, at[1:]) if b > a)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, offsets binary): ids and (start, end) character offsets, both as little-endian 32-bit integers.

    Null texts count as empty; an empty text has no ids. Nothing is shuffled, every row is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = own.encode_all(part.column(1))
                places = [own.offsets(t, i).astype("<i4").tobytes() for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(places, pa.binary())], ["doc_id", "ids", "offsets"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary, offsets binary")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i.as_py() or b"") for i in batch.column(1)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {tokens.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode the ids, hash both.

    The same encoder and decoder as in ``encoded`` and ``decoded``, in one pass, so that the ids
    need not be written. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in parts(batch):
                n, a, b = [], [], []
                for ids in own.encode_all(part.column(1)):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of all ``documents``; see ``digests``."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
