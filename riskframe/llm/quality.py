"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over quantile bins, and so have some pairs of features over coarser
grids. The tables are learned by cyclic boosting: round after round, each feature in turn gets a shallow tree
(three leaves) fitted to the current residuals of its bins, at a small rate; pairs follow on what is left. A
score adds the bins' values: sigmoid(intercept + sum of tables[bin]).

Null and empty texts have defined features (zeros), so they have a score; ties and repeated rows score alike.
Texts of any length are read whole. Without labels, or with one kind of them, every text has the same score. An
empty table has an empty result; other columns of any name play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.spans import scan

FEATURES = ("log_chars", "word_length", "upper", "digits", "space", "lines", "exclaim", "bars", "marks", "stops", "rare_marks", "distinct_words", "repeated_lines", "longest_word", "capital_words")
UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))


def features(text: str) -> list[float]:
    data = text.encode()
    n = len(data) or 1
    words = text.split()
    k = len(words) or 1
    lines = text.split("\n")
    bare = data.translate(None, b"#$%&*@^~+=<>\\_{}[]")
    return [
        float(np.log1p(len(text))),
        len(text) / k,
        (n - len(data.translate(None, UPPER))) / n if data else 0.0,
        (n - len(data.translate(None, DIGIT))) / n if data else 0.0,
        data.count(b" ") / n,
        data.count(b"\n") / n,
        data.count(b"!") / n,
        data.count(b"|") / n,
        (len(data) - len(bare)) / n,
        data.count(b".") / n,
        (data.count(b",") + data.count(b";") + data.count(b":")) / n,
        len(set(words)) / k,
        1 - len(set(lines)) / len(lines),
        float(max(map(len, words), default=0)),
        sum(map(str.istitle, words)) / k,
    ]


class Model:
    """Bin edges and tables by feature, and tables of pairs over every `coarse`-th bin."""

    def __init__(self, edges: list[np.ndarray], intercept: float, tables: list[np.ndarray], pairs: list[tuple[int, int]], pair_edges: list[np.ndarray], pair_tables: list[np.ndarray]) -> None:
        self.edges, self.intercept, self.tables = edges, intercept, tables
        self.pairs, self.pair_edges, self.pair_tables = pairs, pair_edges, pair_tables

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def cut(edges_of: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(edges_of, np.arange(1, bins) / bins))


def leaf(g: np.ndarray | float, h: np.ndarray | float, l2: float) -> np.ndarray | float:
    return g / (h + l2)


def tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values of the bins by a tree of at most three leaves, from sums of gradients and curvatures."""

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    out = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        gain, k, i = max((*split(a, b), i) for i, (a, b) in enumerate(parts))
        if gain <= 0:
            break
        a, b = parts.pop(i)
        parts += [(a, k), (k, b)]
    for a, b in parts:
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum(), l2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Values of a grid by the best cut of one axis and then, in each half, of the other; and its gain."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            out, gain = np.zeros_like(a), 0.0
            for rows in (slice(0, k), slice(k, None)):
                gs, hs = a[rows].sum(0), b[rows].sum(0)
                lg, lh = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                if not len(lg):
                    continue
                each = lg**2 / (lh + l2) + (gs.sum() - lg) ** 2 / (hs.sum() - lh + l2)
                c = int(np.argmax(each))
                gain += float(each[c])
                out[rows, : c + 1] = leaf(lg[c], lh[c], l2)
                out[rows, c + 1 :] = leaf(gs.sum() - lg[c], hs.sum() - lh[c], l2)
            if gain > best[0]:
                best = (gain, out.T if flip else out)
    return best[1], best[0]


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, n_pairs: int = 6, rounds: int = 250, pair_rounds: int = 80, rate: float = 0.1, l2: float = 1.0) -> Model:
    p0 = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    intercept = float(np.log(p0 / (1 - p0)))
    d = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        none = [np.empty(0)] * d
        return Model(none, intercept, [np.zeros(1)] * d, [], none, [])
    edges = [cut(x[:, j], bins) for j in range(d)]
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(d)]
    tables = [np.zeros(len(edges[j]) + 1) for j in range(d)]
    z = np.full(len(y), intercept)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-z))
            step = rate * tree(np.bincount(at[j], y - p, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j])), l2)
            tables[j] += step
            z += step[at[j]]
    pair_edges = [cut(x[:, j], grid) for j in range(d)]
    cell = [np.searchsorted(pair_edges[j], x[:, j], "right") for j in range(d)]
    size = [len(e) + 1 for e in pair_edges]

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = cell[i] * size[j] + cell[j]
        n = size[i] * size[j]
        return np.bincount(k, y - p, n).reshape(size[i], size[j]), np.bincount(k, p * (1 - p), n).reshape(size[i], size[j])

    p = 1 / (1 + np.exp(-z))
    gains = sorted((-pair_tree(*sums(i, j, p), l2)[1], i, j) for i, j in combinations(range(d), 2))
    pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    pair_tables = [np.zeros((size[i], size[j])) for i, j in pairs]
    for _ in range(pair_rounds):
        for table, (i, j) in zip(pair_tables, pairs, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = rate * pair_tree(*sums(i, j, p), l2)[0]
            table += step
            z += step[cell[i], cell[j]]
    return Model(edges, intercept, tables, pairs, pair_edges, pair_tables)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the documents of labels (doc_id, y), a bounded table (see tables.labelled)."""
    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(labels), F.col("id") == F.col("doc_id"))
    # An id that is repeated counts once, with its smallest text: what comes to the driver stays bounded.
    chosen = chosen.groupBy("id", "y").agg(F.min("text").alias("text"))

    def rows_of():
        return lambda columns: [columns[0], columns[1], [features(t or "") for t in columns[2]]]

    rows = scan(chosen.select("id", "y", "text"), ("id", "y", "text"), "id long, y int, x array<double>", rows_of).collect()
    rows.sort(key=lambda r: (r[0] or 0, r[2]))
    return train(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row: doc_id and score (0 to 1, higher: better)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of():
        own = shared.value

        def rows(columns: list) -> list[list]:
            x = np.array([features(t or "") for t in columns[1]]).reshape(-1, len(FEATURES))
            return [columns[0], own.score(x).tolist()]

        return rows

    return scan(docs, ("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", rows_of)
