"""Distributions by day that merge: quantile sketches and bin counts, stored once, for any window of days after.

A day's state is some kilobytes for each feature, whatever its rows. References, quantiles and drift of a window come
from the states of its days; the rows are not read again. Sketched quantiles and shares are off by a rank error that
the sketch size bounds (RANK_ERROR); bin counts under frozen edges are exact. The exact forms are in drift and ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.drift import EPS, bin_counts, frozen, psi_of_counts

#: Size of a sketch, and the rank error that its quantiles keep with 99 % (some 2.3 / k ** 0.9).
SKETCH, RANK_ERROR = 800, 0.006
#: Quantiles that shares are read off, which adds 1 / GRID to the error.
GRID = 1000


def daily_sketches(df: DataFrame, features: list[str], day: str, k: int = SKETCH) -> DataFrame:
    """(day, feature, n, missing, sketch); NaN is missing. Tasks send sketches, not values."""
    long = df.select(day, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([day], features, "feature", "x")
    x = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy(day, "feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def write_days(states: DataFrame, path: str, day: str) -> None:
    """States of days into a store, in the place of what it has of these days; a second run changes nothing."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def window_of(states: DataFrame, day: str, first: int, last: int) -> DataFrame:
    """(feature, n, missing, sketch) of the days from first to last."""
    own = states.where(F.col(day).between(first, last))
    return own.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(window: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, prob, value); features without values are left out."""
    some = window.where("n > missing")
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(float(p)) for p in probs)))
    each = F.arrays_zip(F.array(*(F.lit(float(p)) for p in probs)).alias("prob"), values.alias("value"))
    return some.select("feature", F.inline(F.transform(each, lambda z: F.struct(z["prob"].alias("prob"), z["value"].alias("value")))))


def shares(edges: Column, sketch: Column) -> Column:
    """The shares of the bins that edges cut, closed on the left, read off GRID evenly spaced quantiles."""
    grid = F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit((i + 0.5) / GRID) for i in range(GRID))))
    below = F.transform(edges, lambda e: F.size(F.filter(grid, lambda q: q < e)) / F.lit(float(GRID)))
    ends = F.concat(F.array(F.lit(0.0)), below, F.array(F.lit(1.0)))
    return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.get(ends, i) - F.get(ends, i - 1))


def sketched_reference(window: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges, props, missing_share), as build_reference has it, from the states of a window."""
    cuts = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(i / bins) for i in range(1, bins))))
    edges = window.withColumn("edges", F.when(F.col("n") > F.col("missing"), F.array_distinct(cuts)).otherwise(F.array().cast("array<double>")))
    return frozen(edges.select("feature", "edges", F.when(F.col("n") > F.col("missing"), shares(F.col("edges"), F.col("sketch"))).otherwise(F.array(F.lit(0.0))).alias("props"), (F.col("missing") / F.col("n")).alias("missing_share")))


def sketched_psi(window: DataFrame, reference: DataFrame) -> DataFrame:
    """(feature, psi) of a window against a reference, from its states alone."""
    both = window.join(reference.select("feature", "edges", "props", "missing_share"), "feature")
    now = F.col("missing") / F.col("n")
    own = F.when(F.col("n") > F.col("missing"), shares(F.col("edges"), F.col("sketch"))).otherwise(F.transform("props", lambda p: p * 0.0))
    clip = lambda props, missing: F.transform(F.concat(F.transform(props, lambda p: p * (1 - missing)), F.array(missing)), lambda p: F.greatest(p, F.lit(EPS)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = both.select("feature", clip(own, now).alias("c"), clip(F.col("props"), F.col("missing_share")).alias("r")).withColumns({"_c": total(F.col("c")), "_r": total(F.col("r"))})
    terms = F.zip_with("c", "r", lambda c, r: (c / F.col("_c") - r / F.col("_r")) * F.ln((c / F.col("_c")) / (r / F.col("_r"))))
    return both.select("feature", total(terms).alias("psi"))


def daily_bins(df: DataFrame, reference: DataFrame, features: list[str], day: str) -> DataFrame:
    """(day, feature, bin, n) under a reference's edges, -1 for missing: exact states that add up over days."""
    long = df.select(day, *(F.col(c).cast("double").alias(c) for c in features)).unpivot([day], features, "feature", "x")
    return bin_counts(long.withColumn("x", F.when(~F.isnan("x"), F.col("x"))), reference, (day,)).withColumn("bin", F.coalesce("bin", F.lit(-1)))


def window_psi(bins: DataFrame, reference: DataFrame, day: str, first: int, last: int) -> DataFrame:
    """(feature, psi) of the days from first to last, exact, from stored bin counts."""
    own = bins.where(F.col(day).between(first, last)).groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    return psi_of_counts(own, reference)
