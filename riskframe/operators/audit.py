"""Checks as tables: one row a check, with what it saw and whether it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def structure(df: DataFrame, key: str, features: list[str], forbidden: list[str], order: list[str], gap: int, split: str = "split", day: str = "tx_day") -> DataFrame:
    """(check, seen, ok): keys in one split only, splits in order with `gap` free days between them, no constant
    feature in the first split, none of the forbidden columns among the features. Empty splits count as out of order."""
    spread = df.where(F.col(split).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    inside = lambda s: F.col(split) == s
    bounds = df.agg(
        *(F.min(F.when(inside(s), F.col(day))).alias(f"lo_{s}") for s in order),
        *(F.max(F.when(inside(s), F.col(day))).alias(f"hi_{s}") for s in order),
        *(F.min(F.when(inside(order[0]), F.col(c))).alias(f"min_{c}") for c in features),
        *(F.max(F.when(inside(order[0]), F.col(c))).alias(f"max_{c}") for c in features),
        *(F.count(F.when(inside(order[0]), F.col(c))).alias(f"n_{c}") for c in features),
        F.count_if(inside(order[0])).alias("rows"),
    )
    early = sum((F.coalesce(F.col(f"lo_{b}") - F.col(f"hi_{a}") <= gap, F.lit(True)).cast("long") for a, b in zip(order, order[1:], strict=False)), F.lit(0))
    # A column with one value and some nulls has two levels.
    one_level = lambda c: (F.col(f"n_{c}") == 0) | (F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"n_{c}") == F.col("rows"))
    flat = sum((one_level(c).cast("long") for c in features), F.lit(0))
    own = len(set(features) & set(forbidden))
    seen = {"ordered": early, "constant": flat, "forbidden": F.lit(own)}
    checks = bounds.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("long").alias("seen")) for k, v in seen.items()))))
    return checks.unionByName(spread.select(F.lit("disjoint").alias("check"), "shared").toDF("check", "seen")).withColumn("ok", F.col("seen") == 0)


def expected_shape(df: DataFrame, expected: dict[str, tuple[int, int, int, float]], y: str = "y", split: str = "split", day: str = "tx_day", tolerance: float = 1e-3) -> DataFrame:
    """By split: rows, first and last day, prevalence, and whether they are as expected."""
    g = df.where(F.col(split).isNotNull()).groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.avg(y).alias("prevalence"))
    ok = F.lit(False)
    for s, (rows, first, last, rate) in expected.items():
        same = (F.col("rows") == rows) & (F.col("first_day") == first) & (F.col("last_day") == last) & (F.abs(F.col("prevalence") - rate) <= tolerance)
        ok = F.when(F.col(split) == s, F.coalesce(same, F.lit(False))).otherwise(ok)
    return g.withColumn("ok", ok)


def decision_drift(log: DataFrame, day: str, p: str, decision: str, threshold: Column) -> DataFrame:
    """By day: decisions, those that differ from p >= threshold, and the thresholds in use."""
    want = F.when(F.col(p) >= threshold, "review").otherwise("accept")
    return log.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(~want.eqNullSafe(F.col(decision))).alias("differing"), F.count_distinct(threshold).alias("thresholds"))


def days_present(df: DataFrame, day: str, low: int, high: int) -> DataFrame:
    """Every day from low to high with its rows (0 where there are none)."""
    days = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(day))
    return days.join(df.groupBy(day).agg(F.count(F.lit(1)).alias("n")), day, "left").select(day, F.coalesce("n", F.lit(0)).alias("n"))
