"""Chronological splits with an embargo, and purged walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rowwise import in_days


def chrono_split(day: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    """The name of the half-open day range, null in the embargo between them."""
    out = F.lit(None).cast("string")
    for name, (low, high) in bounds.items():
        out = F.when(in_days(day, low, high), name).otherwise(out)
    return out


@dataclass(frozen=True)
class Fold:
    """Inclusive day ranges of training and validation."""

    fold: int
    train: tuple[int, int]
    valid: tuple[int, int]


def purged_folds(day_min: int, day_max: int, n: int, purge: int, max_window: int) -> list[Fold]:
    """n validation blocks at the end, each trained on all days before it less the purge.

    The purge must cover the longest look-back window, or history would leak across the boundary.
    """
    if purge < max_window:
        raise ValueError(f"purge of {purge} days is shorter than the {max_window}-day window")
    length = (day_max - day_min + 1) // (n + 1)
    if length < 1 or length <= purge:
        raise ValueError("too few days for the folds asked for")
    out = []
    for i in range(n):
        first = day_min + (i + 1) * length
        last = day_max if i == n - 1 else first + length - 1
        out.append(Fold(i, (day_min, first - purge - 1), (first, last)))
    return out


def fold_rows(df: DataFrame, folds: list[Fold], day: str = "tx_day") -> DataFrame:
    """Each row once for each fold and role that its day belongs to; folds are few, so they travel as literals."""
    roles = [F.when(F.col(day).between(*span), F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role"))) for f in folds for role, span in (("train", f.train), ("valid", f.valid))]
    return df.withColumn("_r", F.explode(F.array_compact(F.array(*roles)))).select("*", "_r.fold", "_r.role").drop("_r")


def fold_table(df: DataFrame, folds: list[Fold], y: str, day: str = "tx_day") -> DataFrame:
    return fold_rows(df, folds, day).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))


def split_problems(df: DataFrame, order: list[str], max_window: int, split: str = "split", day: str = "tx_day") -> list[str]:
    """What is wrong with a split: order, overlap or a gap shorter than the longest window. Empty if nothing is."""
    rows = {r[split]: r for r in df.where(F.col(split).isNotNull()).groupBy(split).agg(F.min(day).alias("lo"), F.max(day).alias("hi")).collect()}
    out = [f"{name} is empty" for name in order if name not in rows]
    for a, b in zip(order, order[1:], strict=False):
        if a in rows and b in rows and rows[b]["lo"] <= rows[a]["hi"]:
            out.append(f"{b} does not follow {a}")
    first, second = order[:2]
    if first in rows and second in rows and rows[second]["lo"] - rows[first]["hi"] - 1 < max_window:
        out.append("the embargo is shorter than the longest window")
    return out
