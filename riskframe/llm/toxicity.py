"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is toxic with p = sigmoid(bias + sum of its features' weights); a document is toxic unless none
of its sentences is: P = 1 - prod(1 - p). The weights are trained on that noisy-or likelihood from document
labels alone, and the same sentence scores then say which sentences offend.

Features of a word: the word and its first 4 and 5 letters, lower case. Null and empty texts have one empty
sentence, so their score is that of the bias alone; ties and repeated rows score alike. Texts of any length are
read whole, in time that grows with their length. Without labels no text is toxic (score near 0), with labels of
one kind all texts have that one. An empty table has an empty result; other columns of any name play no part.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.spans import kept, scan
from riskframe.llm.tables import written

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that the weights are fitted on, at most, for each label.
SAMPLE = 3_000


def features(word: str) -> list[str]:
    return [word, word[:4] + "-", word[:5] + "-"] if len(word) > 5 else [word, word[:4] + "-"] if len(word) == 5 else [word]


def sentence_features(text: str) -> list[set[str]]:
    """The distinct features of each sentence."""
    return [{f for w in set(WORD.findall(sentence)) for f in features(w)} for sentence in SENTENCE.findall(text.lower())] or [set()]


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias


class Scorer(dict):
    """Weights of words for one task; as a dict it remembers what a word adds."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        weight = self[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return weight

    def sentences(self, text: str, least: float = 0.5) -> tuple[float, list[dict]]:
        """The document's score, and the sentences with p >= least as (start, end, p)."""
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; their offsets must hold
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        plain = [sum(map(self.__getitem__, set(WORD.findall(s)))) for s in SENTENCE.findall(low)] or [0.0]
        z = np.array(plain) + self.model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        found: list[dict] = []
        if p.max() >= least:
            for m, x in zip(SENTENCE.finditer(low), p, strict=False):
                if x >= least:
                    found.append({"start": m.start(), "end": m.end(), "p": float(x)})
        return score, found


def train(y: np.ndarray, sentences: np.ndarray, row: np.ndarray, col: np.ndarray, n_features: int, *, rate: float = 0.25, rounds: int = 300, l2: float = 2e-4, weight: float = 1.0) -> np.ndarray:
    """Weights of the features and, last, the bias, by Adam on the noisy-or likelihood.

    y and sentences (how many): of each document; row (sentence, counted over all documents) and col (feature):
    what stands where; weight: of a clean document.
    """
    doc, total = np.repeat(np.arange(len(y)), sentences), int(sentences.sum())
    w = np.zeros(n_features + 1)
    w[-1] = -7.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y == 1, 1.0, weight)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], total)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-6), -1.0) * share
        slope = np.minimum(pull, 50)[doc] * p
        grad = np.append(np.bincount(col, slope[row], n_features), slope.sum()) / len(y) - l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_docs: int = 5, most: int = 5_000) -> Model:
    """Trains on at most `sample` documents of each label of labels (doc_id, y), the first by a hash of the id.

    Features in at least min_docs of them take part, at most `most`: those whose counts differ most between the
    labels (chi-squared), ties by name. Only their places in the sentences come to the driver.
    """
    ids = None
    n = {}
    for y in (0, 1):
        own = labels.where(F.col("y") == y)
        n[y] = own.count()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = own if ids is None else ids.union(own)
    chosen = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), F.col("id") == F.col("doc_id"))
    # An id that is repeated counts once, with its smallest text: the sample stays bounded.
    chosen = written(chosen.groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
    size, share = chosen.agg(F.count(F.lit(1)), F.avg("y")).first()
    if not size or share in (0.0, 1.0):
        return Model({}, 5.0 if share else -12.0)

    def distinct_features():
        return lambda columns: [columns[0], [sorted(set().union(*sentence_features(t or ""))) for t in columns[1]]]

    each = scan(chosen, ("y", "text"), "y int, f array<string>", distinct_features).select("y", F.explode("f").alias("f"))
    expected = F.col("n") * share
    chi2 = (F.col("pos") - expected) ** 2 / (expected * (1 - share))
    counts = each.groupBy("f").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).withColumn("chi2", chi2)
    names = [r[0] for r in counts.where("chi2 >= 10.8").orderBy(F.desc("chi2"), "f").limit(most).select("f").collect()]
    place = {f: i for i, f in enumerate(names)}

    def places():
        def rows(columns: list) -> list[list]:
            out: list[list] = [columns[0], columns[1], [], [], []]
            for text in columns[2]:
                found = sentence_features(text or "")
                at = [(i, place[f]) for i, s in enumerate(found) for f in sorted(s) if f in place]
                out[2].append(len(found))
                out[3].append([i for i, _ in at])
                out[4].append([f for _, f in at])
            return out

        return rows

    t = scan(chosen, ("id", "y", "text"), "id long, y int, n int, s array<int>, f array<int>", places).orderBy("id", "y", "n").toArrow().combine_chunks()
    sentences = t["n"].to_numpy()
    start = np.repeat(np.cumsum(sentences) - sentences, t["s"].combine_chunks().value_lengths().to_numpy())
    row, col = t["s"].combine_chunks().flatten().to_numpy() + start, t["f"].combine_chunks().flatten().to_numpy()
    taken = {y: max(1, min(n[y], sample)) for y in n}
    w = train(t["y"].to_numpy(), sentences, row, col, len(names), weight=(n[0] / taken[0]) / (n[1] / taken[1]))
    return Model({f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-3}, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row: doc_id, score (0 to 1), and the sentences with p >= 0.5 as offending: array of (start, end, p)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of():
        scorer = Scorer(shared.value)

        def rows(columns: list) -> list[list]:
            scored = [scorer.sentences(t or "") for t in columns[1]]
            return [columns[0], [s for s, _ in scored], [o for _, o in scored]]

        return rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan(docs, ("doc_id", "text"), f"doc_id {kind}, score double, offending array<struct<start:int,end:int,p:double>>", rows_of)


def below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs whose texts score below the threshold, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep_of():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer.sentences(t or "", 1.0)[0] < threshold for t in texts]

    return kept(docs, "text", keep_of)
