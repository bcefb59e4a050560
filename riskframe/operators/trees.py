"""Additive contributions of boosted trees: exact Shapley values under the cover-weighted paths of the trees.

A leaf is a box: for each feature on its path an interval, and the share of the training rows that took the path's turns
on that feature. A row either falls in the interval (1) or the leaf is reached with that share. The value of a leaf, as
a game of its features, has Shapley values that depend only on which intervals the row falls in, so that each leaf is a
small table by that pattern: computed once on the driver, looked up for all rows of a batch at once in the tasks. A
row's contributions and the base (the mean over the training rows) add up to its log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features on a path up to which a leaf has a table (of 2 to that power rows); rows of a batch.
TABLED, ROWS = 10, 4096


def shapley(inside: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """Shapley values (rows x features) of the game v(S) = value * prod_S inside * prod_(not S) shares."""
    n, d = inside.shape
    out = np.empty((n, d))
    weights = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    for j in range(d):
        # The sum over subsets of the others by their size: coefficients of prod (shares + inside * y).
        sums = np.zeros((n, d))
        sums[:, 0] = 1.0
        for i in range(d):
            if i != j:
                sums[:, 1:] = sums[:, 1:] * shares[i] + sums[:, :-1] * inside[:, i : i + 1]
                sums[:, 0] *= shares[i]
        out[:, j] = value * (inside[:, j] - shares[j]) * (sums @ weights)
    return out


@dataclass(frozen=True)
class Leaf:
    features: np.ndarray
    low: np.ndarray  # a row falls in the box where low < x <= high, for each feature
    high: np.ndarray
    shares: np.ndarray
    value: float
    table: np.ndarray | None  # features x patterns

    def add(self, out: np.ndarray, x: np.ndarray) -> None:
        """Adds the leaf's contributions to out; out and x have a line for each feature, so that all steps run along rows."""
        inside = [(x[f] > low) & (x[f] <= high) for f, low, high in zip(self.features, self.low, self.high, strict=True)]
        if self.table is None:
            out[self.features] += shapley(np.stack(inside, 1).astype(float), self.shares, self.value).T
            return
        pattern = np.zeros(x.shape[1], np.intp)
        for i, own in enumerate(inside):
            pattern |= own.astype(np.intp) << i
        for i, f in enumerate(self.features):
            out[f] += self.table[i].take(pattern)


def leaf(path: list[tuple[int, float, bool, float]], value: float) -> Leaf:
    """path: (feature, threshold, whether the turn is to the left (<=), share of the rows that take it) by depth."""
    features = sorted({p[0] for p in path})
    low, high, shares = np.full(len(features), -np.inf), np.full(len(features), np.inf), np.ones(len(features))
    for f, threshold, left, share in path:
        i = features.index(f)
        shares[i] *= share
        if left:
            high[i] = min(high[i], threshold)
        else:
            low[i] = max(low[i], threshold)
    table = None
    if len(features) <= TABLED:
        patterns = (np.arange(1 << len(features))[:, None] >> np.arange(len(features)) & 1).astype(float)
        table = np.ascontiguousarray(shapley(patterns, shares, value).T)
    return Leaf(np.array(features, int), low, high, shares, value, table)


@dataclass(frozen=True)
class Trees:
    leaves: list[Leaf]
    base: float

    def contributions(self, x: np.ndarray, features: int) -> np.ndarray:
        out, lines = np.zeros((features, len(x))), np.ascontiguousarray(x.T)
        for own in self.leaves:
            if len(own.features):
                own.add(out, lines)
        return out.T


def read_trees(model: GBTClassificationModel) -> Trees:
    """The leaves of a fitted model, in log-odds (twice its margin); a few calls for each node, rows are not touched."""
    leaves: list[Leaf] = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        open_ = [(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), [])]
        while open_:
            node, path = open_.pop()
            if node.subtreeDepth() == 0:
                leaves.append(leaf(path, 2.0 * weight * node.prediction()))
                continue
            split, n = node.split(), node.impurityStats().count()
            if "Continuous" not in split.getClass().getSimpleName():
                raise ValueError("only continuous splits")
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                open_.append((child, [*path, (split.featureIndex(), split.threshold(), left, child.impurityStats().count() / n)]))
    return Trees(leaves, float(sum(x.value * x.shares.prod() for x in leaves)))


def tree_contributions(df: DataFrame, id: str, columns: list[str], trees: Trees, names: list[str] | None = None) -> DataFrame:
    """(id, feature, contribution): a row for each of df's rows and features, whose values are numbers without nulls.

    names: of the features, where columns has other ones; columns of one name are one feature, added up in the row's own
    task. The trees are broadcast; they do not grow with the rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)
    said = list(dict.fromkeys(names or columns))
    same = np.array([[float(n == s) for s in said] for n in names or columns])

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).astype(float)
                found = shared.value.contributions(x, len(columns)) @ same
                row, place = np.divmod(np.arange(found.size), len(said))
                feature = pa.DictionaryArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(said)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), feature, pa.array(found.reshape(-1))], [id, "feature", "contribution"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(explained, f"`{id}` {kind}, feature string, contribution double")
