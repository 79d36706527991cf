"""Near-duplicates by SimHash fingerprints and their Gray-order index, then MinHash buckets; exact likeness decides.

First the index of ``simhash`` proposes: fingerprints of the shingle sets that are within ``DISTANCE``
bits. A pair at likeness 0.8 differs in some ten of 64 bits, so that finds part of the pairs; the
buckets propose what it leaves apart. Every text is filed under ``BANDS`` keys of ``ROWS`` minima each; a pair at likeness 0.8 shares no
key with probability (1 - 0.8 ** 4) ** 32 < 1e-7. First each member of a bucket is compared with the
bucket's pivot; then, only in buckets whose members these links leave apart, members outside the
bucket's largest group are compared with members of other groups: with the likeliest few first, and
with all that are left at last, so that a large group of copies is mostly joined by few pairs. Pairs
go by their signatures first: with pivots by the minima of the keys (a pair at 0.8 fails ``LIKELY``
once in some 24,000), else by ``FINE`` further ones (``FINE_LIKELY``: less than once in a million).
A link needs the exact likeness of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_each, keyed, stored
from .components import components
from .simhash import links as close_fingerprints
from .simhash import of_digests

SEED = 42
SHINGLE, LIKENESS = 5, 0.8
BANDS, ROWS = 32, 4
LIKELY = 0.65
FINE, FINE_LIKELY = 1024, 0.74
#: Members of other groups that a member is compared with, round by round (None: all).
TRIES = (4, None)
#: Pairs whose signatures are compared at a time.
AT_ONCE = 1 << 14



def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of ``n`` maps of the digests onto themselves."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), np.random.default_rng(seed + 1).integers(0, 1 << 63, n, np.uint64)


_KEYS, _FINE = _permutations(BANDS * ROWS, SEED), _permutations(FINE, SEED + 2)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted digests of the distinct word shingles of the whole text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        return np.array([digest(join(words), SEED)], np.uint64)
    return np.unique(np.fromiter((digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)))), np.uint64, len(words) - size + 1))


def signature(own: np.ndarray, maps: tuple[np.ndarray, np.ndarray] = _KEYS) -> np.ndarray:
    """The minima of a set under fixed permutations; the empty set has the greatest value throughout."""
    factor, shift = maps
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(low, (own[at : at + 1024] * factor[:, None] + shift[:, None]).min(1), out=low)
    return low


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node: digest of the shingle set, so that texts with equal sets are one node; fp: its SimHash; sig: a byte of each minimum."""
    for batch in batches:
        node, fp, sig, keys = [], [], [], []
        for text in batch.column(1):
            own = shingles(text.as_py())
            low = signature(own)
            node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            fp.append(of_digests(own))
            sig.append((low >> np.uint64(24)).astype(np.uint8).tobytes())
            keys.append([xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) for k in range(0, len(low), ROWS)])
        flat = pa.array(_signed(np.array(keys, np.uint64).ravel()))
        offsets = pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(np.array(node, np.uint64))), pa.array(_signed(np.array(fp, np.uint64))), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["row", "node", "fp", "sig", "keys"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = [(signature(shingles(t.as_py()), _FINE) >> np.uint64(24)).astype(np.uint8).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], ["node", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["node", "own"])


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likeness by signatures of single bytes, less what equals by chance."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            x, y = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), -1) for c in ("sig", "sig2"))
            yield f.loc[_estimate(x, y) >= LIKELY, ["a", "b"]]


def _apart(frames: Iterator[pd.DataFrame], most: int | None) -> Iterator[pd.DataFrame]:
    """Likely pairs of different groups within buckets (the rows of a bucket follow each other).

    Each pair has a member outside the bucket's largest group; such a member is given its ``most``
    likeliest partners. A pair comes out of the first of the buckets that it shares only.
    """

    def pairs(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, node, root = (f[c].to_numpy() for c in ("key", "node", "root"))
        sig = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(len(f), -1)
        keys = np.stack(f["keys"].to_list())  # in the order of the bands, so that equal keys stand in one place
        start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(f)]
        a, b = [], []
        for s, e in zip(start[:-1], start[1:]):
            groups, size = np.unique(root[s:e], return_counts=True)
            for i in np.flatnonzero(root[s:e] != groups[size.argmax()]) + s:
                other = np.flatnonzero(root[s:e] != root[i]) + s
                near = np.concatenate([_estimate(sig[i], sig[other[at : at + AT_ONCE]]) for at in range(0, len(other), AT_ONCE)])
                order = np.lexsort((node[other], -near))[:most]
                chosen = other[order[near[order] >= FINE_LIKELY]]
                shared = np.where(keys[chosen] == keys[i], keys[chosen], np.iinfo(np.int64).max)
                found = node[chosen[shared.min(axis=1, initial=np.iinfo(np.int64).max) == key[i]]]
                a.append(np.full(len(found), node[i]))
                b.append(found)
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    held = None
    for frame in frames:
        if len(frame):
            f = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = f["key"].to_numpy()
            cut = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
            if cut:
                yield from pairs(f.iloc[:cut])
            held = f.iloc[cut:]
    if held is not None:
        yield from pairs(held)


def _exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        near = [likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= LIKENESS for x, y in zip(f["own"], f["own2"])]
        yield f.loc[near, ["a", "b"]]


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that connect what fingerprints within ``DISTANCE`` bits connect, found by the Gray-order index."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = nodes.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = close_fingerprints(least.select("fp")).distinct()
    near = edges.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    return equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(rows: DataFrame) -> DataFrame:
    """(row, doc_id, component) for (row, doc_id, text): what pairs of likeness ``LIKENESS`` or more connect."""
    found = stored(rows.select("row", "text").mapInArrow(_signatures, "row long, node long, fp long, sig binary, keys array<long>"), "signatures")
    nodes = stored(found.groupBy("node").agg(F.min("row").alias("row")), "nodes")
    own = stored(found.join(nodes.select("row"), "row", "left_semi").select("row", "node", "fp", "sig", "keys"), "node-signatures")
    filed = own.select("node", F.explode("keys").alias("key"))
    pivots = filed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot")
    buckets = stored(filed.join(pivots, "key"), "buckets")

    def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """``column`` of both ends; the end with many pairs is joined last, where the skew can be split."""
        a = table.select(F.col("node").alias("a"), column)
        b = table.select(F.col("node").alias("b"), F.col(column).alias(f"{column}2"))
        return pairs.join(b, "b").join(a, "a")

    def texts(chosen: DataFrame) -> DataFrame:
        """(node, text) of the nodes of ``chosen`` (distinct)."""
        return rows.select("row", "text").join(nodes.join(chosen, "node", "left_semi").select("row", "node"), "row").select("node", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = stored(texts(ends).mapInArrow(_sets, "node long, own binary"), "shingle-sets")
        return stored(with_both(pairs, sets, "own").select("a", "b", "own", "own2").mapInPandas(_exact, "a long, b long"), "links")

    close = stored(proposed(own.select("node", "fp")), "close-fingerprints")
    known = verified(close)
    joined = stored(components(known), "groups")
    a, b = (joined.select(F.col("vertex").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    star = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    # only pairs that the fingerprints have left apart
    star = star.join(a, "a", "left").join(b, "b", "left").where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
    first = stored(with_both(star, own, "sig").select("a", "b", "sig", "sig2").mapInPandas(_likely, "a long, b long"), "likely-pairs")
    links, tried = stored(known.unionByName(verified(first)), "links"), first.unionByName(close)
    root = stored(components(links), "groups")
    fine = None
    for most in TRIES:
        placed = stored(buckets.select("key", "node").join(root.withColumnRenamed("vertex", "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
        mixed = stored(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "mixed")
        if mixed.isEmpty():
            break
        open_ = placed.join(mixed, "key", "left_semi")
        if fine is None:  # in later rounds fewer buckets are mixed, never others
            fine = stored(texts(open_.select("node").distinct()).mapInArrow(_fine, "node long, sig binary").join(own.select("node", "keys"), "node"), "fine-signatures")
        open_ = open_.join(fine, "node").select("key", "node", "root", "sig", "keys")
        apart = open_.repartition("key").sortWithinPartitions("key").mapInPandas(partial(_apart, most=most), "a long, b long").distinct()
        rest = stored(apart.join(tried, ["a", "b"], "left_anti"), "pairs-apart")
        if not rest.isEmpty():
            links, tried = stored(links.unionByName(verified(rest)), "links"), tried.unionByName(rest)
            root = stored(components(links), "groups")
    root = root.withColumnRenamed("vertex", "node")
    named = nodes.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return found.select("row", "node").join(named, "node").join(rows.select("row", "doc_id"), "row").select("row", "doc_id", "component")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays."""
    rows = keyed(docs)
    return first_of_each(rows, near_groups(rows)).select(*docs.columns)
