"""Exact integer k-means: float32 products shortlist centroids, exact integers decide.

For a row x and a centroid c the float32 product x.c, in whatever order it is summed, is within
g |x| |c| of the exact one, g = (d + 2) u / (1 - (d + 2) u) and u = 2**-24 (two roundings more are
those of x and c themselves). That gives an interval for each squared distance; a centroid whose
interval lies above another's is out, and where more than one is left, distances are computed in
integers and the smaller number wins a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, CLUSTERS, DIMS, ROUNDS, SEED = 64, 16, 64, 3, 1
#: Float products (rows times centroids) that are held at a time.
PRODUCTS = 1 << 22
#: Tasks whose sums are added together first, before the sums of a cluster meet.
LANES = 64
#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def _safe(dims: int) -> int:
    """Components up to this size have squared distances in an int64."""
    return int((2.0**62 / dims) ** 0.5 / 2)


class Screen:
    """Centroids (lists of Python integers) that rows are assigned to."""

    def __init__(self, centroids: list[list[int]]):
        self.exact, self.dims = centroids, len(centroids[0])
        self.safe = _safe(self.dims)
        self.narrow = np.array([max(map(abs, c)) <= self.safe for c in centroids])
        self.ints = np.array([c if ok else [0] * self.dims for c, ok in zip(centroids, self.narrow)], np.int64)
        self.single = self.ints.astype(np.float32)
        self.norm2 = (self.ints * self.ints).sum(axis=1).astype(np.float64)
        # the largest component of a wide centroid, rounded down
        self.reach = np.array([float(min(max(map(abs, c)), 1 << 1000)) * (1 - 2 * U64) for c in centroids])
        g = (self.dims + 2) * U32
        self.g = g / (1 - g) * (1 + 2.0**-20)

    def shortlist(self, rows: np.ndarray) -> np.ndarray:
        """Which centroids can be nearest to each row (int64, components up to ``safe``): a matrix of booleans."""
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (rows.astype(np.float32) @ self.single.T).astype(np.float64)
        norm2 = (rows * rows).sum(axis=1).astype(np.float64)[:, None]
        near = norm2 + self.norm2 - 2 * dot
        # the product's error, and a generous one for the few float64 operations of this line and the last
        error = 2 * self.g * np.sqrt(norm2 * self.norm2) * (1 + 2.0**-40) + 16 * U64 * (norm2 + self.norm2 + 2 * np.abs(dot))
        upper = np.where(self.narrow, near + error, np.inf).min(axis=1, keepdims=True)
        # a wide centroid is out if one component alone is too far
        gap = self.reach - np.abs(rows).max(axis=1, initial=0).astype(np.float64)[:, None] * (1 + 2 * U64)
        return np.where(self.narrow, near - error <= upper, ~(gap > np.sqrt(np.maximum(upper, 0)) * (1 + 2.0**-40)))

    def _distances(self, rows: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows ``at`` to centroids ``to``; objects if any is wide."""
        if self.narrow[to].all():
            out = np.empty(len(at), np.int64)
            step = max(1, PRODUCTS // self.dims)
            for k in range(0, len(at), step):
                d = rows[at[k : k + step]] - self.ints[to[k : k + step]]
                out[k : k + step] = (d * d).sum(axis=1)
            return out
        return np.array([sum((x - y) ** 2 for x, y in zip(rows[i].tolist(), self.exact[j])) for i, j in zip(at.tolist(), to.tolist())] + [None], object)[:-1]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and exact squared distance to the nearest centroid of each row."""
        cluster, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object if not self.narrow.all() else np.int64)
        step = max(1, PRODUCTS // len(self.exact))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            at, to = np.nonzero(self.shortlist(part))  # by row, then by number; each row has one at least
            first = np.flatnonzero(np.diff(at, prepend=-1))
            exact = self._distances(part, at, to)
            least = np.minimum.reduceat(exact, first) if len(first) else exact
            best = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(at)))))
            own = best[np.flatnonzero(np.diff(at[best], prepend=-1))]  # the smallest number among ties
            cluster[k : k + step], distance[k : k + step] = to[own], exact[own]
        return cluster, distance

    def nearest_wide(self, row: list[int]) -> tuple[int, int]:
        d, j = min((sum((x - y) ** 2 for x, y in zip(row, c)), j) for j, c in enumerate(self.exact))
        return j, d


def _integers(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) of a list column without nulls: rows of int64, and wide rows as Python integers by place."""
    x = np.asarray(lists.flatten()).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    wide = np.flatnonzero((np.abs(q) > _safe(dims)).any(axis=1))
    big = {}
    for i in wide.tolist():  # exact also where the product is beyond a double
        big[i] = [(n * scale) // d for n, d in (float(v).as_integer_ratio() for v in x[i])]
        q[i] = 0
    return q.astype(np.int64), big


def _numbers(frame: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one cluster, added as Python integers."""
    sums = [0] * len(frame["sums"].iloc[0])
    for own in frame["sums"]:
        sums = [a + int(b) for a, b in zip(sums, own)]
    return pd.DataFrame({"cluster": [int(frame["cluster"].iloc[0])], "lane": [int(frame["lane"].iloc[0])], "n": [int(frame["n"].sum())], "sums": [[str(a) for a in sums]]})


def _moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: every non-empty centroid becomes the exact floor of its rows' mean."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        n, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            q, big = _integers(batch.column(0), dims, scale)
            cluster, _ = screen.nearest(q)
            if big:
                cluster[list(big)] = -1
            for j in np.unique(cluster[cluster >= 0]).tolist():
                own = q[cluster == j]
                n[j] += len(own)
                sums[j] = [a + b for a, b in zip(sums[j], own.sum(axis=0).tolist())]
            for row in big.values():
                j, _ = screen.nearest_wide(row)
                n[j] += 1
                sums[j] = [a + b for a, b in zip(sums[j], row)]
        some = [j for j in range(len(centroids)) if n[j]]
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lane] * len(some), pa.int32()), pa.array([n[j] for j in some], pa.int64()), pa.array([[str(a) for a in sums[j]] for j in some], pa.list_(pa.string()))], ["cluster", "lane", "n", "sums"])

    form = "cluster int, lane int, n long, sums array<string>"
    parts = rows.select("vector").mapInArrow(run, form)  # a row for each task and cluster
    lanes = parts.groupBy("cluster", "lane").applyInPandas(_numbers, form)
    moved = {r["cluster"]: [int(a) // r["n"] for a in r["sums"]] for r in lanes.groupBy("cluster").applyInPandas(_numbers, form).collect()}  # a row for each cluster
    return [moved.get(j, c) for j, c in enumerate(centroids)]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector that is kept, and the final centroids.

    Kept are vectors of ``dims`` components of which none is null or not finite; components count as
    floor(scale * x). The first centroids are the ``clusters`` vectors (all, if fewer) with the
    smallest SHA-256 of ``seed:id``; of equal ids the lesser vector comes first, rows without id last.
    Each round assigns all vectors to the nearest centroid (ties: smaller number) and moves every
    centroid that has vectors to the floor of their mean. Rows with null or repeated ids are rows of
    their own. A squared distance that fits no long is null. No vectors give no rows and no centroids.
    """
    x = F.col(vector_col)
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    rows = stored(vectors.where(whole).select(F.col(id_col).alias("vec_id"), x.alias("vector")), "vectors")
    seeds = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(clusters).select("vector")
    centroids = [[(n * scale) // d for n, d in (float(v).as_integer_ratio() for v in r["vector"])] for r in seeds.collect()]
    kind = vectors.schema[id_col].dataType.simpleString()
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    for _ in range(rounds):
        centroids = _moved(rows, centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            q, big = _integers(batch.column(1), dims, scale)
            cluster, distance = screen.nearest(q)
            numbers = distance.tolist()
            for i, row in big.items():
                cluster[i], numbers[i] = screen.nearest_wide(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([d if d < 1 << 63 else None for d in numbers], pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kept ``embeddings`` with cluster, distance, inertias and the centroid's digest; see ``clustered``.

    An inertia that holds a distance beyond a long, or that is beyond one itself, is null.
    """
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    found = stored(found, "assigned")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    total = each.agg(F.sum("d").alias("total"), F.sum("beyond").alias("beyond_all"))
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    long = lambda value, beyond: F.when(F.col(beyond) == 0, F.expr(f"try_cast({value} as long)"))
    # a row for each cluster: their number is a parameter
    facts = each.crossJoin(F.broadcast(total)).join(F.broadcast(digests), "cluster").select("cluster", long("d", "beyond").alias("cluster_inertia"), long("total", "beyond_all").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ASSIGNED = """
a{i} AS MATERIALIZED (
  SELECT v.rid, v.vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
  FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY distance, c.cluster) = 1)"""
_MOVED = """
m{j} AS (
  SELECT cluster, list(floor(s / n)::BIGINT ORDER BY place) AS q
  FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM a{i}) GROUP BY ALL) GROUP BY cluster),
c{j} AS MATERIALIZED (SELECT cluster, coalesce(m{j}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{j} USING (cluster))"""

OP12_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(place - 1 AS INTEGER) AS cluster, q
  FROM (SELECT q, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) AS place FROM v) WHERE place <= 16),"""
    + ",".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(ROUNDS))
    + ","
    + _ASSIGNED.format(i=ROUNDS)
    + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
"""
)
