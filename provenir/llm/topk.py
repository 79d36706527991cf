"""Exact top-k search by inner product on a bit-sliced index.

Quantised vectors are laid down in blocks; a block keeps, for each component, one bitmap for each
binary digit of (component - least of the block). A query adds the slices of all components, each
shifted by the digits of its weight, with bitwise full adders, so that one machine word adds for 64
rows. The sum is again a set of slices; from the most significant one downward they split the rows
into those surely among the best and those still open, until k are left. What stands on the boundary
is resolved by exact scores and the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE, K, EVERY = 64, 20, 20
#: Candidates of a block and queries of a group.
BLOCK, GROUP = 16384, 256
#: Products up to this bound go through the slices; beyond it scores are added in Python's integers.
MOST = 1 << 62


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, keep: list[str] | None = None) -> DataFrame:
    """(vec_id, dims, q) and the columns ``keep``: components as floor(scale * x); rows without an id or a whole finite vector are left out."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: F.when(F.abs(v) * scale >= float(1 << 63), F.raise_error(F.lit("a quantised component does not fit a long"))).otherwise(F.floor(v * scale)).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dims"), q.alias("q"), *(keep or []))


class Slices:
    """The bit-sliced index of one block of rows (an integer matrix)."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.low = rows.min(axis=0)
        self.digits = max(1, int((rows.max(axis=0) - self.low).max()).bit_length())
        words = (self.n + 63) // 64
        shifted = np.zeros((words * 64, rows.shape[1]), np.int64)
        shifted[: self.n] = rows - self.low
        planes = [np.packbits(np.ascontiguousarray((shifted >> b & 1).astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64) for b in range(self.digits)]
        up = np.stack(planes, axis=1)  # component, digit, word
        self.slices = np.stack([up, ~up])  # a negative weight adds the complement
        full = np.zeros(words * 64, np.uint8)
        full[: self.n] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the scores (less a constant of block and query)."""
        size, sign = np.abs(query), (query < 0).astype(int)
        waiting: dict[int, list[np.ndarray]] = {}
        for b in range(self.digits):
            for w in range(int(size.max(initial=0)).bit_length()):
                d = np.flatnonzero(size >> w & 1)
                if len(d):
                    waiting.setdefault(b + w, []).append(self.slices[sign[d], d, b])
        out, place = [], 0
        while waiting:
            column = waiting.pop(place, [])
            maps = np.concatenate(column) if column else np.zeros((1, len(self.all)), np.uint64)
            while len(maps) > 1:  # full adders: three maps of a place give one, and one of the next
                third = len(maps) // 3
                if third:
                    a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                    ab = a ^ b
                    carry, total, rest = (a & b) | (ab & c), ab ^ c, maps[3 * third :]
                else:
                    carry, total, rest = maps[:1] & maps[1:2], maps[:1] ^ maps[1:2], maps[2:]
                waiting.setdefault(place + 1, []).append(carry)
                maps = np.concatenate([total, rest]) if len(rest) else total
            out.append(maps[0])
            place += 1
        return out

    def best(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that hold the k best scores, with all rows that tie with the last."""
        sure, still = np.zeros_like(self.all), self.all
        for plane in reversed(self.score_slices(query)):
            high = still & plane
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                still = high
            else:
                sure |= high
                still = still & ~plane
                if n == k:
                    still = np.zeros_like(still)
                    break
        return np.flatnonzero(np.unpackbits((sure | still).view(np.uint8), bitorder="little"))


def _ints(packed: bytes, n: int, dims: int) -> np.ndarray:
    """Packed vectors: four bytes a component where that holds all of them, else eight."""
    return np.frombuffer(packed, np.int32 if len(packed) == 4 * n * dims else np.int64).astype(np.int64).reshape(n, dims)


def _wide_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact scores of components of any size; a score that does not fit a long is an error."""
    scores = rows.astype(object) @ query.astype(object)
    if max(map(abs, scores.tolist())) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return scores.astype(np.int64)


def _meet(k: int):
    """A block against a group of queries: the k best of the block for each query."""

    def run(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(group):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims, ids = int(block["dims"].iloc[0]), np.frombuffer(block["ids"].iloc[0], np.int64)
        rows, queries = _ints(block["rows"].iloc[0], len(ids), dims), _ints(group["rows"].iloc[0], len(group["ids"].iloc[0]) // 8, dims)
        largest = max(abs(int(rows.min())), abs(int(rows.max())))
        index = Slices(rows) if largest < MOST else None
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for own, query in zip(np.frombuffer(group["ids"].iloc[0], np.int64).tolist(), queries):
            if index is None or largest * sum(map(abs, query.tolist())) >= MOST:
                at = np.flatnonzero(ids != own)
                score = _wide_scores(rows[at], query) if len(at) else np.empty(0, np.int64)
            else:
                at = index.best(query, min(index.n, k + int(np.count_nonzero(ids == own))))
                at = at[ids[at] != own]
                score = rows[at] @ query
            order = np.lexsort((ids[at], ~score))[:k]  # ~ as the least long has no negative
            found.append((own, ids[at][order], score[order]))
        return pd.DataFrame({"query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64), "vec_id": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found])})

    return run


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: ids and vectors as bytes (the rows of a key are at most a block)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        own = {c: [frame[c].iloc[0]] for c in key}
        q = np.array(frame["q"].tolist(), np.int64)
        narrow = q.min() >= -(1 << 31) and q.max() < 1 << 31
        return pd.DataFrame({**own, "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "rows": [q.astype(np.int32 if narrow else np.int64).tobytes()]})

    return rows.groupBy(*key).applyInPandas(pack, "dims int, " + ", ".join(f"{c} long" for c in key[1:]) + ", ids binary, rows binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, all other rows being candidates.

    Score: the inner product of the quantised vectors; ties go to the smaller vec_id, equal rows of
    one id rank side by side. Rows with the query's own id are no candidates of it; repeated query
    rows are one query (of equal ids with different vectors, the least vector). Vectors are compared
    only with those of their own length. Null vectors, those with null or non-finite components and
    rows without id take no part; a component or score that fits no long is an error. No rows give no rows.
    """
    rows = stored(quantised(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))), id_col, vector_col, keep=["_query"]).where("dims > 0").withColumn("row", F.monotonically_increasing_id()), "quantised")
    # a row for each vector length: how many rows and how many queries
    totals = [(r["dims"], -(-r["n"] // BLOCK), -(-r["q"] // GROUP)) for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if("_query").alias("q")).collect()]
    totals = [x for x in totals if x[2]]
    if not totals:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    n_blocks, n_groups = (F.create_map(*[F.lit(y) for x in totals for y in (x[0], x[i])])[F.col("dims")] for i in (1, 2))
    rows = rows.where(F.col("dims").isin([x[0] for x in totals]))
    blocks = stored(_packed(rows.withColumn("block", F.pmod(F.xxhash64("row"), n_blocks)), ["dims", "block"]), "blocks")
    queries = rows.where("_query").groupBy("vec_id", "dims").agg(F.min("q").alias("q"))
    groups = stored(_packed(queries.withColumn("grp", F.pmod(F.xxhash64("vec_id"), n_groups)), ["dims", "grp"]), "query-groups")
    # every group of queries meets every block of its length: the stated queries against all rows, in blocks
    left = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), (n_groups - 1).cast("long"))))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (n_blocks - 1).cast("long"))))
    part = left.groupBy("dims", "block", "grp").cogroup(right.groupBy("dims", "block", "grp")).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for every twentieth id; see ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
