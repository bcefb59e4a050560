"""Exact top-k by inner product: distributed histogram selection.

Queries are taken in blocks of a bounded size. For a block, every candidate is scored in the tasks that read
it; each task counts its scores by query and bin, and the sums over all tasks say in which bin the k-th best
score of each query lies. The next pass counts inside that bin alone, until it is one score wide or holds few
scores. A last pass keeps the scores from that bin up, and ties go to the smaller id.

Components are floor(scale * x) and scores whole numbers. Vectors that are null or hold a null or non-finite
component, and rows with a null id, take no part; neither do candidates of another length than the query or
with the query's own id. Of repeated query ids the smallest vector asks. Empty vectors score 0. Repeated candidates each count. A query with fewer than k
candidates gets them all. Scores that could pass 2**62 raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block (about), bins of a pass, candidates scored at once.
BLOCK, BINS, ROWS = 2048, 1024, 1024
SCHEMA = "query_id long, vec_id long, score long"


def valid(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def matrices(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number components) for each length of vector."""
    sizes = vectors.value_lengths().to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield ids.to_numpy()[at], np.floor(scale * flat).reshape(len(at), int(size))


class Block:
    """Some queries of one length, and the window of scores that is being counted for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float) -> None:
        self.ids, self.vectors = ids, vectors
        bound = np.abs(vectors).sum(1) * largest
        if bound.max(initial=0) >= 2**62:
            raise ArithmeticError("inner products may not fit 64 bits")
        self.exact_in_float = bound.max(initial=0) < 2**52
        self.low = -bound.astype(np.int64)
        self.high = bound.astype(np.int64) + 1
        self.width = np.maximum(1, -(-(2 * bound.astype(np.int64) + 1) // BINS))
        self.need: np.ndarray | None = None

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of queries by candidates, and which of them count."""
        if self.exact_in_float:
            s = (self.vectors @ vectors.T).astype(np.int64)
        else:
            s = self.vectors.astype(np.int64) @ vectors.T.astype(np.int64)
        return s, self.ids[:, None] != ids[None, :]


def scored(candidates: DataFrame, shared, scale: int, count: bool, k: int, schema: str) -> DataFrame:
    """Counts of the top bins of each task, or its best rows from each query's low score up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        bins = {d: np.zeros((len(b.ids), BINS), np.int64) for d, b in blocks.items()} if count else {}
        best = {d: [[np.empty(0, np.int64)] * 3] for d in blocks}
        for batch in batches:
            for ids, vectors in matrices(batch.column(0), batch.column(1), scale):
                if (b := blocks.get(vectors.shape[1])) is None:
                    continue
                for at in range(0, len(ids), ROWS):
                    own = ids[at : at + ROWS]
                    s, other = b.scores(own, vectors[at : at + ROWS])
                    if count:
                        place = (s - b.low[:, None]) // b.width[:, None]
                        q, c = np.nonzero(other & (place >= 0) & (s < b.high[:, None]))
                        n = len(b.ids) * BINS
                        bins[vectors.shape[1]] += np.bincount(q * BINS + place[q, c], minlength=n).reshape(-1, BINS)
                    else:
                        q, c = np.nonzero(other & (s >= b.low[:, None]))
                        rows = best[vectors.shape[1]]
                        rows.append([q, own[c], s[q, c]])
                        if sum(len(r[0]) for r in rows) > 50_000 + 2 * k * len(b.ids):
                            best[vectors.shape[1]] = [top(rows, k)]
        for d, b in blocks.items():
            if count:
                above = np.cumsum(bins[d][:, ::-1], 1)[:, ::-1] - bins[d]
                q, place = np.nonzero((bins[d] > 0) & (above < b.need[:, None]))
                out = [b.ids[q], place, bins[d][q, place]]
            else:
                q, ids, s = top(best[d], k)
                out = [b.ids[q], ids, s]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], [c.split()[0] for c in schema.split(", ")])

    return candidates.select("vec_id", "embedding").mapInArrow(run, schema)


def top(rows: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The k best of each query: score from high to low, then id."""
    q, ids, s = (np.concatenate([r[i] for r in rows]) for i in range(3))
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return [q[keep], ids[keep], s[keep]]


def search(vectors: DataFrame, is_query: Column, k: int = 10, *, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row where is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    n, largest = rows.agg(F.count_if("is_query"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(scale * x)))).cast("double"))).first()
    blocks = max(1, -(-n // block))
    results = []
    for i in range(blocks):
        chosen = rows.where(F.col("is_query") & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow().combine_chunks()
        if not chosen.num_rows:
            continue
        ids, vecs = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in chosen.columns)
        own = {v.shape[1]: Block(q, v, largest or 0.0) for q, v in matrices(ids, vecs, scale)}
        results.append(selected(spark, rows, own, k, scale))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, results).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def selected(spark, rows: DataFrame, own: dict[int, Block], k: int, scale: int) -> DataFrame:
    """Candidates with at least the k-th best score of each query of a block, few more."""
    need = {d: np.full(len(b.ids), k, np.int64) for d, b in own.items()}
    open_ = True
    while open_:
        for d, b in own.items():
            b.need = need[d]
        counts = scored(rows, spark.sparkContext.broadcast(own), scale, True, k, "query_id long, bin long, n long")
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        summed = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        needed = {d: dict(zip(b.ids.tolist(), need[d].tolist(), strict=True)) for d, b in own.items()}
        wanted = spark.createDataFrame([(q, x) for own_need in needed.values() for q, x in own_need.items()], "query_id long, need long")
        # Of each query: the highest bin with which the count reaches what is needed, else the lowest.
        hit = summed.join(F.broadcast(wanted), "query_id").where(F.col("upto") - F.col("n") < F.col("need"))
        found = {r[0]: r[1:] for r in hit.groupBy("query_id").agg(F.min("bin"), F.max("upto"), F.min_by("n", "bin")).collect()}
        open_ = False
        for d, b in own.items():
            for i, q in enumerate(b.ids.tolist()):
                place, upto, n = found.get(q, (0, 0, 0))
                if need[d][i] <= 0 or upto < need[d][i]:  # settled, or fewer than k: all from the window's low end up
                    need[d][i] = 0
                    continue
                b.low[i] += place * b.width[i]
                b.high[i] = min(b.high[i], b.low[i] + b.width[i])
                if b.width[i] == 1 or upto <= 4 * k:
                    need[d][i] = 0
                else:
                    need[d][i] -= upto - n
                    b.width[i] = max(1, -(-b.width[i] // BINS))
                    open_ = True
    return scored(rows, spark.sparkContext.broadcast(own), scale, False, k, SCHEMA)
