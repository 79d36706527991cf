"""SimHash fingerprints and their near-duplicate groups through a Gray-order hierarchical index.

The index: every fingerprint is filed under each choice of blocks that two fingerprints within
``distance`` bits must share (pigeonhole), so each such pair meets in at least one bucket. Buckets
are laid out in the order of the Gray rank, cut into nodes of bounded size, and every node keeps the
bit pattern that its members share. Two nodes (or two groups inside a node) are compared only if
their shared patterns differ in at most ``distance`` bits; differences add up on the way down.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of_each, keyed, stored, table
from .components import components

SEED = 42
DISTANCE = 3
#: Members of a node of the index; a task holds two nodes at a time.
NODE = 2048
LEAF, FAN = 16, 8
#: (fingerprints up to this number, blocks): more blocks give longer keys and more copies of a row.
BLOCKS = ((1 << 22, 4), (1 << 30, 5), (None, 6))

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.intp)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of the whole text; no words (or null): zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, counts = len(words) - shingle + 1, np.zeros(2048, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        h = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))], np.uint64)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def of_digests(digests: np.ndarray) -> int:
    """SimHash of shingles that are digested already; none: zero."""
    if not len(digests):
        return 0
    counts = np.bincount((digests.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    return sum(1 << i for i in np.flatnonzero(2 * (counts.reshape(8, 256) @ _BITS).ravel() > len(digests)).tolist())


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; one pass over the texts, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each pattern in the Gray code: neighbours in this order differ in few bits."""
    r = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def shared_pattern(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group: the mask of the bits that all members share, and these bits."""
    all_and, all_or = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
    mask = ~(all_and ^ all_or)
    return mask, all_and & mask


def _expand(i: np.ndarray, j: np.ndarray, fan: int, n_i: int, n_j: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(fan)
    a = np.broadcast_to((i[:, None] * fan + step)[:, :, None], (len(i), fan, fan)).ravel()
    b = np.broadcast_to((j[:, None] * fan + step)[:, None, :], (len(i), fan, fan)).ravel()
    ok = (a < n_i) & (b < n_j)
    return a[ok], b[ok]


def close_pairs(x: np.ndarray, y: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance`` bits of two Gray-ordered nodes (or i < j within one)."""
    own, y = y is None, x if y is None else y
    levels = []
    for size in (LEAF * FAN, LEAF):
        levels.append([shared_pattern(v, np.arange(0, len(v), size)) for v in (x, y)])
    (mx, vx), (my, vy) = levels[0]
    i, j = np.nonzero(np.bitwise_count((vx[:, None] ^ vy) & mx[:, None] & my) <= distance)
    if own:
        i, j = i[i <= j], j[i <= j]
    (mx, vx), (my, vy) = levels[1]
    i, j = _expand(i, j, FAN, len(vx), len(vy))
    near = np.bitwise_count((vx[i] ^ vy[j]) & mx[i] & my[j]) <= distance
    if own:
        near &= i <= j
    i, j = i[near], j[near]
    out_i, out_j = [np.empty(0, np.intp)], [np.empty(0, np.intp)]
    for at in range(0, len(i), 4096):  # leaves, a bounded number at a time
        a, b = _expand(i[at : at + 4096], j[at : at + 4096], LEAF, len(x), len(y))
        near = np.bitwise_count(x[a] ^ y[b]) <= distance
        if own:
            near &= a < b
        out_i.append(a[near])
        out_j.append(b[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the least member that the pairs connect it to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` out of ``blocks`` nearly equal blocks."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_NODE_SCHEMA = "kind int, a long, b long, t int, key long, node long, mask long, value long, members binary"


def _index(frames: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Cut the ordered fingerprints of a partition into nodes.

    Closed buckets are searched at once and give edges of a spanning forest (kind 0); nodes of
    buckets that go on in another node or partition come out whole (kind 1).
    """
    from pyspark import TaskContext

    number, held, made = TaskContext.get().partitionId() << 32, None, 0

    def edges(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        root = forest(len(fps), i, j)
        k = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"kind": 0, "a": fps[k].view(np.int64), "b": fps[root[k]].view(np.int64), "t": 0, "key": 0, "node": 0, "mask": 0, "value": 0, "members": None}) if len(k) else None

    def node(t: int, key: int, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        nonlocal made
        mask, value = shared_pattern(fps, np.zeros(1, np.intp))
        made += 1
        yield pd.DataFrame({"kind": [1], "a": [0], "b": [0], "t": [t], "key": [key], "node": [number + made], "mask": mask.view(np.int64), "value": value.view(np.int64), "members": [fps.tobytes()]})
        yield edges(fps, *close_pairs(fps, distance=distance))

    def rows(t: np.ndarray, key: np.ndarray, fps: np.ndarray, first: bool, last: bool) -> Iterator[pd.DataFrame]:
        change = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[change, len(fps)])
        open_ = np.zeros(len(change), bool)
        open_[0] |= first
        open_[-1] |= last
        small = ~open_ & (size > 1) & (size <= 2 * LEAF)
        member = np.repeat(small, size)
        end = np.repeat(change + size, size)
        pairs = [(k := np.flatnonzero(member & (np.arange(len(fps)) + d < end)), k + d) for d in range(1, int(size[small].max(initial=1)))]
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
            yield edges(fps, i[near], j[near])
        for k in np.flatnonzero(~small & (open_ | (size > 2 * LEAF))):
            own = fps[change[k] : change[k] + size[k]]
            if not open_[k] and len(own) <= NODE:
                yield edges(own, *close_pairs(own, distance=distance))
            else:
                for at in range(0, len(own), NODE):
                    yield from node(int(t[change[k]]), int(key[change[k]]), own[at : at + NODE])

    first = True
    for frame in frames:
        if not len(frame):
            continue
        part = [frame["t"].to_numpy(), frame["key"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)]
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part)]
        t, key, fps = part
        cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1])).max(initial=-1)) + 1
        if cut:
            yield from (x for x in rows(t[:cut], key[:cut], fps[:cut], first, False) if x is not None)
            first = False
        held = [x[cut:] for x in part]
        while len(held[2]) > 4 * NODE:  # a bucket of any size leaves node by node
            yield from (x for x in node(int(held[0][0]), int(held[1][0]), held[2][:NODE]) if x is not None)
            held, first = [x[NODE:] for x in held], True
    if held is not None:
        yield from (x for x in rows(*held, first, True) if x is not None)


def links(fps: DataFrame, distance: int = DISTANCE, count: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly what all pairs within ``distance`` bits connect.

    ``fps`` has distinct fingerprints in the column fp (signed long). Spanning edges replace the
    pairs of each node, so their number stays below rows x keys however dense a bucket is.
    """
    count = fps.count() if count is None else count
    blocks = max(next(b for most, b in BLOCKS if most is None or count <= most), distance + 1)
    keys = masks(distance, blocks)
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    filed = fps.select("fp", rank.alias("rank")).select("fp", "rank", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in keys])).alias("t", "key"))
    order = ["t", "key", "rank"]
    laid = filed.repartitionByRange(*order).sortWithinPartitions(*order).select("t", "key", "fp")
    index = stored(laid.mapInPandas(lambda frames: _index(frames, distance), _NODE_SCHEMA), "gray-index")
    nodes = index.where("kind = 1").select("t", "key", "node", "mask", "value", "members")
    other = nodes.select("t", "key", *[F.col(c).alias(f"{c}2") for c in ("node", "mask", "value", "members")])
    differ = F.bit_count(F.col("value").bitwiseXOR(F.col("value2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    pairs = nodes.join(other, ["t", "key"]).where((F.col("node") < F.col("node2")) & (differ <= distance)).select("members", "members2")

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, q in zip(frame["members"], frame["members2"]):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                i, j = close_pairs(x, y, distance)
                both, root = np.concatenate([x, y]), forest(len(x) + len(y), i, j + len(x))
                k = np.flatnonzero(root != np.arange(len(both)))
                yield pd.DataFrame({"a": both[k].view(np.int64), "b": both[root[k]].view(np.int64)})

    return index.where("kind = 0").select("a", "b").unionByName(pairs.mapInPandas(across, "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other; equal texts collapse
    to one fingerprint before the search; rows with a null id keep their row, and count as no
    smallest id unless the whole group has none. An empty table gives no rows.
    """
    own = stored(with_fingerprints(docs, id_col, text_col), "fingerprints")
    least = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(links(least.select("fp"), distance))
    named = least.join(root.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "rooted")
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(group, "root").select("fp", "component_id")
    return own.join(final, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row, that with the smallest id (null last)."""
    rows = keyed(docs)
    found = near_duplicates(rows, distance, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    return first_of_each(rows, found.join(rows.select("row", "doc_id"), "row")).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
