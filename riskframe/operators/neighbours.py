"""Exact nearest neighbours among all rows of a table, in blocks that bounds leave out.

Of rows at one point, only the k + 1 of the smallest keys can be among the neighbours of any row, and rows there differ in
their neighbours by their own key alone: points are searched once, however many rows have them. Space is cut at medians of
a sample into cells, and a cell in its task into blocks of bounded size. A block knows its centre, its radius, and how far
its points' k-th neighbours within the block are at most. Two blocks need to meet only where the triangle inequality lets
a nearer neighbour (or one as near with a smaller key) lie in the other. The blocks that a cell's blocks need go to its
task by a shuffle, in parts of bounded size; there a point looks into a block only if its box is near enough.

The driver sees a line for each block (a centre and five numbers) and the sample, never the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.sources.io import written

#: Rows of a block, of candidates that a task holds at once, and of the sample that cells are cut by.
BLOCK, CHUNK, SAMPLE = 512, 131_072, 131_072
#: Blocks of a cell (about), and sampled rows that a cell needs at least.
CELL, LEAST = 32, 16
#: A point that this share of the rows have goes to them by a broadcast.
HOT = 0.01
DIGITS = 9  # of squared distances, so that rounding does not decide between equal ones
UNIT = 10.0**-DIGITS


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, added up by coordinate: nothing cancels."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        out += (a[:, None] - b[None, :]) ** 2
    return out


def array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def meetings(centres: np.ndarray, radius: np.ndarray, reach: np.ndarray, least: list, worst: list, of: list[int] | None = None) -> list[list[int]]:
    """For each block (or those of `of`) the blocks that may hold a nearer neighbour of one of its rows, itself among them."""
    out = []
    for q in range(len(centres)) if of is None else of:
        gap = np.maximum(0.0, np.sqrt(apart(centres[q : q + 1], centres)[0]) - radius[q] - radius) * (1 - 1e-12)
        near = np.flatnonzero(gap**2 <= reach[q] + UNIT).tolist()
        # As far as the worst one, at the nearest: only a smaller key is better.
        out.append([c for c in near if c == q or gap[c] ** 2 < reach[q] - 0.4 * UNIT or worst[q] is None or least[c] < worst[q]])
    return out


def cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, cut) of each node of a tree of medians: node i has 2 i + 1 (up to the cut) and 2 i + 2 below it."""
    at, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    own = {0: sample}
    for i in range(len(at)):
        x = own.pop(i)
        if len(x):
            at[i] = (x.max(0) - x.min(0)).argmax()
            cut[i] = np.median(x[:, at[i]])
        left = x[:, at[i]] <= cut[i]
        own[2 * i + 1], own[2 * i + 2] = x[left], x[~left]
    return at, cut


def cell_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, cut = tree
    node = np.zeros(len(x), int)
    for _ in range((len(at) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), at[node]] > cut[node])
    return node - len(at)


def halves(x: np.ndarray, block: int) -> list[np.ndarray]:
    """Places of x in blocks of at most `block`, by halving along the widest coordinate."""
    open_, out = [np.arange(len(x))], []
    while open_:
        own = open_.pop()
        if len(own) <= block:
            out.append(own)
            continue
        wide = (x[own].max(0) - x[own].min(0)).argmax()
        own = own[np.argsort(x[own, wide], kind="stable")]
        open_ += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


class Best:
    """The `most` nearest candidates of each point so far: distances, keys and points, ties by key."""

    def __init__(self, points: np.ndarray, most: int, keys: np.ndarray) -> None:
        self.points, self.most = points, most
        self.far = np.full((len(points), most), np.inf)
        self.ids = np.full((len(points), most), keys[0], keys.dtype)
        self.at = np.zeros((len(points), most, points.shape[1]))

    @property
    def reach(self) -> np.ndarray:
        return self.far[:, -1]

    def meet(self, keys: np.ndarray, x: np.ndarray) -> None:
        """Takes in the candidates of a block, for the points that its box is near enough to."""
        gap = np.maximum(0.0, np.maximum(x.min(0) - self.points, self.points - x.max(0)))
        rows = np.flatnonzero((gap**2).sum(1) * (1 - 1e-12) <= self.reach + UNIT)
        if not len(rows):
            return
        far = np.round(apart(self.points[rows], x), DIGITS)
        limit = self.reach[rows]
        if far.shape[1] > self.most:
            limit = np.minimum(limit, np.partition(far, self.most - 1, axis=1)[:, self.most - 1])
        row, col = np.nonzero(far <= limit[:, None])
        if not len(row):
            return
        seen, place = np.unique(rows[row], return_inverse=True)
        group = np.concatenate([np.repeat(np.arange(len(seen)), self.most), place])
        dist = np.concatenate([self.far[seen].reshape(-1), far[row, col]])
        ids = np.concatenate([self.ids[seen].reshape(-1), keys[col]])
        order = np.lexsort((ids, dist, group))
        starts = np.searchsorted(group[order], np.arange(len(seen)))
        kept = order[starts[:, None] + np.arange(self.most)]
        points = np.concatenate([self.at[seen].reshape(-1, x.shape[1]), x[col]])
        self.far[seen], self.ids[seen], self.at[seen] = dist[kept], ids[kept], points[kept]


def nearest(rows: DataFrame, k: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(key, x, near) of rows (key, x array<double> of one length, no nulls): the k nearest other rows' points, nearest
    first, ties by key; fewer where there are fewer rows."""
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    batch_key = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    own = written(rows.select(F.col("key").cast("bigint" if batch_key == pa.int64() else "string").alias("key"), "x"), "points")
    key_kind = own.schema["key"].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    candidates = written(own.withColumn("place", place).where(F.col("place") <= k + 1), "candidates")
    n, total = candidates.count(), own.count()
    sample = candidates.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).select("x").toArrow()["x"].combine_chunks()
    if not len(sample):
        sample = candidates.limit(1).select("x").toArrow()["x"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], f"key {kind}, x array<double>, near array<array<double>>")
    width = len(sample[0])
    sample = array(sample, width)
    tree = cuts(sample, max(1, min(n // (CELL * block), len(sample) // LEAST)).bit_length() - 1)

    def celled(batches):
        for batch in batches:
            cell = cell_of(array(batch.column(1), width), tree)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["key", "x", "place", "cell"])

    def keys_of(column) -> np.ndarray:
        return np.array(column.to_pylist())

    def blocked(cell: pa.Table) -> pa.Table:
        """A cell's candidates in blocks, of which a line each says what there is to be known outside."""
        keys, x, first = keys_of(cell["key"]), array(cell["x"].combine_chunks(), width), cell["place"].to_numpy() == 1
        out: list[tuple] = []
        for at in halves(x, block):
            asks = at[first[at]]
            b, c = Best(x[asks], k + 1, keys), x[at].mean(0)
            b.meet(keys[at], x[at])
            # The worst k-th neighbour within the block, itself counted, and the largest key that is as far.
            reach = float(b.reach.max()) if len(asks) else -1.0
            worst = np.sort(b.ids[:, -1][b.reach == reach])[-1] if len(asks) and np.isfinite(reach) else None
            out.append((cell["cell"][0].as_py(), keys[at].tolist(), x[at].reshape(-1), first[at].tolist(), c, float(np.sqrt(apart(c[None], x[at]).max())), reach, np.sort(keys[at])[0].item(), None if worst is None else worst.item()))
        kinds = [pa.int32(), pa.list_(batch_key), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.float64(), pa.float64(), batch_key, batch_key]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["cell", "keys", "flat", "first", "centre", "radius", "reach", "least", "worst"])

    schema = f"cell int, keys array<{key_kind}>, flat array<double>, first array<boolean>, centre array<double>, radius double, reach double, least {key_kind}, worst {key_kind}"
    cells = candidates.mapInArrow(celled, f"key {key_kind}, x array<double>, place int, cell int")
    blocks = written(cells.groupBy("cell").applyInArrow(blocked, schema).select(F.expr("uuid()").alias("block"), "*"), "blocks")
    lines = blocks.select("block", "cell", "centre", "radius", "reach", "least", "worst").toArrow()
    names, of_cell = np.array(lines["block"].to_pylist()), lines["cell"].to_numpy()
    known = (array(lines["centre"].combine_chunks(), width), lines["radius"].to_numpy(), lines["reach"].to_numpy(), lines["least"].to_pylist(), lines["worst"].to_pylist())
    per, needs = max(1, chunk // block), []
    for cell in np.unique(of_cell):
        asked = np.flatnonzero(of_cell == cell)
        wanted = sorted({c for met in meetings(*known, of=asked.tolist()) for c in met})
        for part in range(0, len(wanted), per):
            held = wanted[part : part + per]
            needs.append(pa.table({"block": names[[*held, *asked]], "to": np.full(len(held) + len(asked), cell), "part": np.full(len(held) + len(asked), part // per), "asks": np.arange(len(held) + len(asked)) >= len(held)}))

    def compared(table: pa.Table) -> pa.Table:
        """What the points of a cell's blocks find in one part of the blocks that they need."""
        asks = table["asks"].to_numpy()
        keys, x = [keys_of(c.values) for c in table["keys"]], [c.values.to_numpy().reshape(-1, width) for c in table["flat"]]
        names_ = table["block"].to_pylist()
        held = np.flatnonzero(~asks)
        low, high = (np.array([f(x[i], 0) for i in held]) for f in (np.min, np.max))
        found: list[tuple[np.ndarray, Best]] = []
        for i in np.flatnonzero(asks):
            points = x[i][np.array(table["first"][i].as_py())]
            if not len(points):
                continue
            b = Best(points, k + 1, keys[i])
            b.meet(keys[i], x[i])
            gap = (np.maximum(0.0, np.maximum(low - points.max(0), points.min(0) - high)) ** 2).sum(1) * (1 - 1e-12)
            for j in np.argsort(gap, kind="stable"):
                if gap[j] > b.reach.max() + UNIT:
                    break
                if names_[held[j]] != names_[i]:
                    b.meet(keys[held[j]], x[held[j]])
            found.append((points, b))
        if not found:
            return pa.table({"x": pa.array([], pa.list_(pa.float64())), "near": pa.array([], near_kind)})
        points, far, ids, at = (np.concatenate(z) for z in zip(*((p, b.far, b.ids, b.at) for p, b in found), strict=True))
        real = np.isfinite(far)
        each = pa.StructArray.from_arrays([pa.array(far[real]), pa.array(ids[real].tolist(), batch_key), pa.array(list(at[real]), pa.list_(pa.float64()))], ["far", "id", "point"])
        ends = np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)
        return pa.table({"x": pa.array(list(points), pa.list_(pa.float64())), "near": pa.ListArray.from_arrays(pa.array(ends), each).cast(near_kind)})

    near_kind = pa.list_(pa.struct([("far", pa.float64()), ("id", batch_key), ("point", pa.list_(pa.float64()))]))
    wanted = F.broadcast(spark.createDataFrame(pa.concat_tables(needs)))
    parts = blocks.select("block", "keys", "flat", "first").join(wanted, "block").groupBy("to", "part")
    each = parts.applyInArrow(compared, f"x array<double>, near array<struct<far: double, id: {key_kind}, point: array<double>>>")
    # A block compares its own rows in each part: the same neighbours may come several times.
    each = each.groupBy("x").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))
    if total - n > HOT * total:
        each = written(each, "near")
        hot = own.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(k + 1, HOT * total)).select("x")
        hot = F.broadcast(each.join(F.broadcast(hot), "x"))  # 1 / HOT points at most
        joined = own.join(hot, "x").unionByName(own.join(hot.select("x"), "x", "left_anti").join(each, "x"))
    else:
        joined = own.join(each, "x")
    others = F.slice(F.filter("near", lambda z: z["id"] != F.col("key")), 1, k)
    return joined.select(F.col("key").cast(kind).alias("key"), "x", F.transform(others, lambda z: z["point"]).alias("near"))
