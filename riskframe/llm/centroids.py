"""Centroid clustering with whole numbers: assignment by a vantage-point tree, exact means.

In each round the tree over the centroids is rebuilt and broadcast (k centroids, a parameter). A task searches it for
its vectors best-first: each vector takes the node of its smallest lower bound, all vectors at a node are compared at
once, and a vector is done when its smallest bound exceeds its best distance. Bounds come from the triangle inequality
with a margin for rounding, and a node as near as the best so far is still visited, so that ties are seen: of equal
squared distances, which are exact whole numbers, the smaller centroid number wins. Tasks return sums by cluster, k
rows at most, whatever their vectors; means are exact floors.

Vectors of another length than `dims`, null ones, and those with null or non-finite components take no part. Repeated
rows each count; rows with a null id are clustered but start no centroid. Of rows with equal ids the smaller vector
starts first. With fewer vectors than k there are fewer centroids, and none give an empty result. Other columns are
left out, whatever their names. Components so large that squared distances could pass 2**62 raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import drop_written, written
from riskframe.llm.topk import valid

#: Centroids of a leaf, vectors searched at once.
LEAF, ROWS = 4, 4096


class VantageTree:
    """Nodes in arrays: the vantage point, two children, and the range of distances from the point to each child."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.points: list[np.ndarray] = []  # of a leaf all of its centroids, else the vantage point
        self.children: list[tuple[tuple[int, float, float], ...]] = []
        self.grow(np.arange(len(centroids)))

    def grow(self, own: np.ndarray) -> int:
        node = len(self.points)
        self.points.append(own)
        self.children.append(())
        if len(own) > LEAF:
            self.points[node] = own[:1]
            rest = own[1:]
            away = np.sqrt(squared(self.centroids[own[:1]], self.centroids[rest])[0])
            inner = away <= np.median(away)
            found = []
            for side in (inner, ~inner):
                if side.any():
                    found.append((self.grow(rest[side]), away[side].min(), away[side].max()))
            self.children[node] = tuple(found)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector."""
        n = len(vectors)
        bound = np.full((n, len(self.points)), np.inf)
        bound[:, 0] = 0
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids), np.int64)
        row = np.arange(n)
        while len(row):
            node = bound[row].argmin(1)
            least = bound[row, node]
            open_ = least <= np.sqrt(best[row].astype(np.float64)) * (1 + 1e-9)
            row, node, least = row[open_], node[open_], least[open_]
            bound[row, node] = np.inf
            order = np.argsort(node, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
                at, which = row[group], node[group[0]]
                points = self.points[which]
                away = squared(vectors[at], self.centroids[points])
                first = away.argmin(1)
                d, c = away[np.arange(len(at)), first], points[first]
                better = (d < best[at]) | (d == best[at]) & (c < number[at])
                best[at[better]], number[at[better]] = d[better], c[better]
                for child, low, high in self.children[which]:
                    to = np.sqrt(away[:, 0].astype(np.float64))
                    gap = np.maximum(low - to, to - high) - 1e-9 * (to + high)
                    bound[at, child] = np.maximum(least[group], gap)
        return number, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows as exact 64-bit integers."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * top * top < 1 << 52:  # every sum below is a whole number that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def whole_vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(rows: DataFrame, tree: VantageTree) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                cluster, distance = shared.value.nearest(whole_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def sums(rows: DataFrame, tree: VantageTree) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster that is not empty; at most k times dims numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = shared.value.centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                vectors = whole_vectors(whole.column(1).slice(at, ROWS))
                cluster, _ = shared.value.nearest(vectors)
                np.add.at(total, cluster, vectors)
                count += np.bincount(cluster, minlength=k)
        c, p = np.nonzero(np.broadcast_to(count[:, None] > 0, (k, dims)))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(count[c]), pa.array(total[c, p])], ["cluster", "part", "n", "total"])

    parts = rows.mapInArrow(summed, "cluster int, part int, n long, total long").groupBy("cluster", "part").agg(F.sum("n"), F.sum("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, _, n, total in sorted(parts.collect()):
        out.setdefault(cluster, (n, []))[1].append(total)
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, *, scale: int = 256, dims: int = 64, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of `dims` components.

    A component x counts as floor(scale * x). Centroids start as the k vectors of the smallest sha256 of `seed` and
    the id, and move to their vectors' means `rounds` times.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id"), x.alias("x")).where(F.coalesce(F.size("x") == dims, F.lit(False)) & valid(F.col("x")))
    far = (1 << 61) // (4 * dims)
    largest = F.array_max(F.transform("x", lambda c: F.abs(c * scale)))
    fine = F.when(largest * largest < float(far), F.transform("x", lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit("squared distances may not fit 64 bits")).cast("array<bigint>"))
    rows = written(kept.select("vec_id", fine.alias("x")), "vectors")
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").orderBy(key, "x").limit(k).select("x").collect()
    if not first:
        first = rows.orderBy("x").limit(k).select("x").collect()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r[0] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, total) in sums(rows, VantageTree(centroids)).items():
            centroids[c] = [t // n for t in total]
    found = written(assign(rows, VantageTree(centroids)), "clusters")
    drop_written(rows)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select(*(f.split()[0] for f in schema.split(", ")))
