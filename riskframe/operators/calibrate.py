"""Class weights, priors, preparation and calibrators: each fit is a few aggregates over all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import apply_calibrator, logit, sigmoid
from riskframe.operators.ordered import quantiles

LOW, HIGH = -30.0, 30.0


def arm_weights(df: DataFrame, y: str, ratio: float) -> DataFrame:
    """By imbalance arm: the weight of positives, the prior that training sees, and the factor on its odds."""
    g = df.agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    odds = F.try_divide("pos", "neg")
    arms = {
        "natural": (F.lit(1.0), odds),
        "weighted": (F.try_divide("neg", "pos"), odds),
        "oversampled": (F.lit(1.0), F.lit(ratio)),
        "oversampled_weighted": (F.lit(1.0 / ratio), F.lit(ratio)),
    }
    rows = F.array(*(F.struct(F.lit(a).alias("arm"), w.alias("weight"), F.try_divide(o, 1 + o).alias("prior"), F.try_divide(w * o, odds).alias("odds_factor")) for a, (w, o) in arms.items()))
    return g.select(F.inline(rows))


def standardised(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the training median, then centred and scaled by training rows (constant columns to 0)."""
    long = train.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")
    medians = {r["feature"]: r["value"] for r in quantiles(long, ["feature"], "x", [0.5]).collect()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) for c in columns}
    s = train.agg(*(F.avg(x).alias(f"m_{c}") for c, x in filled.items()), *(F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items())).first()
    return df.withColumns({c: F.coalesce(F.try_divide(x - (s[f"m_{c}"] or 0.0), F.lit(s[f"s_{c}"] or 0.0)), F.lit(0.0)) for c, x in filled.items()})


def distinct_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(_z, _y, _k): log-odds, label and how many rows have both; kept, as each step of a fit reads it again."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(logit(F.col(p)).alias("_z"), F.col(y).cast("double").alias("_y"))
    return rows.agg(F.count(F.lit(1)).cast("double").alias("_k")).persist()


def excess(rows: DataFrame, points: list[float]) -> list[float]:
    """sum((sigmoid(_z + b) - _y) * _k) of distinct_scores for each b: a sum a point from each task."""
    shifts = np.array(points)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shifts))
        for batch in batches:
            z, y, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i, b in enumerate(shifts):
                with np.errstate(over="ignore"):
                    total[i] += ((1.0 / (1.0 + np.exp(-(z + b))) - y) * k).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shifts), dtype=np.int32)), pa.array(total)], ["i", "s"])

    found = rows.select("_z", "_y", "_k").mapInArrow(summed, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [r["s"] for r in sorted(found, key=lambda r: r["i"])]


def fit_shift(df: DataFrame, y: str, p: str, rounds: int = 6, steps: int = 32) -> float | None:
    """b with the least log loss of sigmoid(logit(p) + b): sum(sigmoid - y) rises in b, so each round weighs `steps`
    values in one pass and keeps the interval where the sign turns. None without both classes."""
    rows = distinct_scores(df, y, p)
    found = shift_of(rows, rounds, steps)
    rows.unpersist()
    return found


def shift_of(rows: DataFrame, rounds: int = 6, steps: int = 32) -> float | None:
    least, most = rows.agg(F.min("_y"), F.max("_y")).first()
    if least is None or least == most:
        return None
    low, high = LOW, HIGH
    for _ in range(rounds):
        points = [low + (high - low) * i / steps for i in range(steps + 1)]
        sums = excess(rows, points)
        at = next((i for i in range(1, steps + 1) if not sums[i] < 0), steps)
        low, high = points[at - 1], points[at]
    return (low + high) / 2


def fit_platt(df: DataFrame, y: str, p: str, rounds: int = 25) -> tuple[float, float] | None:
    """(a, b) of sigmoid(a * logit(p) + b) by Newton steps, five sums each. None without both classes or a spread."""
    rows = distinct_scores(df, y, p)
    found = platt_of(rows, rounds)
    rows.unpersist()
    return found


def platt_of(rows: DataFrame, rounds: int = 25) -> tuple[float, float] | None:
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = sigmoid(a * F.col("_z") + b)
        w, e, z, k = q * (1 - q), q - F.col("_y"), F.col("_z"), F.col("_k")
        s = rows.agg(F.min("_y"), F.max("_y"), F.sum(e * z * k), F.sum(e * k), F.sum(w * z * z * k), F.sum(w * z * k), F.sum(w * k)).first()
        if s[0] is None or s[0] == s[1]:
            return None
        g1, g0, h11, h10, h00 = s[2:]
        det = h11 * h00 - h10 * h10
        if det <= 1e-12 * h11 * h00:
            return None
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        a, b = a - da, b - db
        if math.hypot(da, db) < 1e-10:
            break
    return a, b


Calibrator = tuple[str, float, float]  # kind, a, b
IDENTITY: Calibrator = ("identity", 1.0, 0.0)


def analytic(odds_factor: float) -> Calibrator:
    """The calibrator that takes an assumed factor out of the odds: b = -ln(factor)."""
    return "analytic", 1.0, -math.log(odds_factor)


def calibrated(p: Column, found: Calibrator) -> Column:
    return apply_calibrator(p, *found)


def choose(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """Calibrators fitted on all folds but the last, and their log loss on the last: (kind, a, b, log_loss), the best first."""
    last = df.agg(F.max(fold)).first()[0]
    early, late = df.where(F.col(fold) < last), df.where(F.col(fold) == last)
    seen = distinct_scores(early, y, p)
    shift, platt = shift_of(seen), platt_of(seen)
    seen.unpersist()
    kinds = {"identity": (1.0, 0.0)} | ({"shift": (1.0, shift)} if shift is not None else {}) | ({"platt": platt} if platt else {})
    z = F.col("_z")
    rows = late.select(logit(F.col(p)).alias("_z"), F.col(y).cast("double").alias("_y"))
    tables = [
        F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), (-(F.col("_y") * F.ln(q) + (1 - F.col("_y")) * F.ln(1 - q))).alias("loss"))
        for k, (a, b) in kinds.items()
        for q in [F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), sigmoid(a * z + b)))]
    ]
    return rows.select(F.inline(F.array(*tables))).groupBy("kind", "a", "b").agg(F.avg("loss").alias("log_loss")).orderBy("log_loss", "kind")
